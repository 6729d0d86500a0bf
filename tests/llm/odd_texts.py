"""Texts at the edges of what a document may be."""

ODD = [None, "", " \n\t ", "one", "one two three four", "É è \x00 ß \U0001f600 x", "same text of more than five words", "same text of more than five words", "word " * 30000]
