import re

import pytest
from odd_texts import ODD

from fidelis.llm import substrings


def brute(rows, least=substrings.MIN_WORDS, run=substrings.RUN):
    """(doc_id, start, end, first doc_id, first start) of each occurrence to remove, with repetitions, by plain Python."""
    found = [(doc, start, end, i, nth, unit) for i, (doc, text) in enumerate(rows) for nth, (start, end, unit) in enumerate(substrings.units(text or "", least))]
    seen, again = {}, {}
    for doc, start, end, i, nth, unit in sorted(found, key=lambda f: (f[0] is None, f[0] or 0, *f[1:4])):
        first = seen.setdefault(unit, (doc, start))
        if seen[unit] is not first or (i, nth) != again.setdefault(("kept", unit), (i, nth)):
            again[i, nth] = (doc, start, end, *first, unit.count(" ") + 1)
    out = []
    for i, nth in (k for k in again if k[0] != "kept"):
        a, b = nth, nth
        while (i, a - 1) in again:
            a -= 1
        while (i, b + 1) in again:
            b += 1
        if sum(again[i, x][5] for x in range(a, b + 1)) >= run:
            out.append(again[i, nth][:5])
    return sorted(out, key=str)


def got(df, **more):
    return sorted(((r.doc_id, r.start, r.end, r.first_doc_id, r.first_start) for r in substrings.repeated_units(df, **more).collect()), key=str)


def test_corpus_matches_brute_force(corpus):
    rows = [(r.doc_id, r.text) for r in corpus.collect()]
    assert got(corpus) == brute(rows)
    assert got(corpus, run=1) == brute(rows, run=1)


PASSAGE = "This is a passage of many words. It has several sentences, all of them long enough. And it ends with this one here."


def test_a_passage_inside_other_text_is_found(docs_of):
    texts = [f"Start of one {PASSAGE} Tail of it.", f"Quite another beginning\n{PASSAGE}", "clean words that nobody else has said before.", *ODD]
    rows = got(docs_of(texts), run=6)
    assert rows == brute(list(enumerate(texts)), run=6)
    assert {(d, f) for d, _, _, f, _ in rows} == {(1, 0), (10, 9)}
    assert {(d, f) for d, _, _, f, _ in got(docs_of(texts))} == {(1, 0)}


def test_removal_keeps_the_rest_and_the_offsets(docs_of):
    texts = [PASSAGE, f"é {PASSAGE} Own words.", None]
    df = docs_of(texts)
    out = {r.doc_id: r for r in substrings.remove_units(df).collect()}
    assert out[0].text == PASSAGE and out[0].removed is None and out[2].text is None
    spans = [(s.start, s.end) for s in out[1].removed]
    keep, at = [], 0
    for s, e in spans:
        keep.append(texts[1][at:s])
        at = e
    assert out[1].text == "".join(keep) + texts[1][at:] and out[1].text.endswith("Own words.") and len(spans) == 2


def test_of_repeated_rows_one_stays(docs_of):
    line, other = "six words are in this line", "another line of more than six words"
    for ids, want in (([5, 2, 2], [(2, 2), (5, 2)]), ([1, 1, 2], [(1, 1), (2, 1)]), ([4, 4, 4], [(4, 4)] * 2), ([None, None, 3], [(None, 3)] * 2)):
        df = docs_of([line] * 3, ids)
        assert [(d, f) for d, _, _, f, _ in got(df, run=6)] == sorted(want, key=str)
        assert got(df, run=6) == brute([(i, line) for i in ids], run=6)
        assert sorted(r.text for r in substrings.remove_units(df, run=6).collect()) == ["", "", line]
        assert sorted(r.text for r in substrings.remove_units(df, passages=True).collect()) == ["", "", line]
    # Rows that share an id but not a text lose their own repeats only.
    df = docs_of([line, f"{other}\n{line}", other], [7, 7, 8])
    assert sorted((r.doc_id, r.text) for r in substrings.remove_units(df, run=6).collect()) == [(7, f"{other}\n"), (7, line), (8, "")]
    assert substrings.repeated_units(docs_of(["a"]).where("false")).count() == 0


def test_a_run_is_broken_by_a_unit_of_its_own(docs_of):
    a, b, c, d = ("one two three four five six", "seven eight nine ten eleven twelve", "red green blue cyan pink grey", "oak ash elm fir yew box")
    texts = ["\n".join((a, b, c)), "\n".join((a, b, d, c)), "\n".join((a, "short", b, c))]
    assert {x[0] for x in got(docs_of(texts))} == {2} and got(docs_of(texts), run=12) == brute(list(enumerate(texts)), run=12)


def left_by_passages(df):
    out = {r.doc_id: r.text for r in substrings.remove_units(df, passages=True).collect()}
    return {d: " ".join((t or "").split()) for d, t in out.items()}


def test_short_lines_and_verse_are_found(docs_of):
    verse = "\n".join(f"row {i} of few words" for i in range(20))
    left = left_by_passages(docs_of(["Les.\nOwn line here", "Another own line\nLes.", verse, f"Heading\n{verse}\nEnd"]))
    assert left == {0: "Les. Own line here", 1: "Another own line", 2: " ".join(verse.split()), 3: "Heading End"}


def test_verse_with_other_line_breaks_is_found(docs_of):
    words = [f"w{i}" for i in range(60)]
    texts = ["\n".join(" ".join(words[i : i + 3]) for i in range(a, 60, 3)) for a in (0, 1)]
    assert len(left_by_passages(docs_of(texts))[1].split()) <= 50


def test_a_script_without_blanks_is_found(docs_of):
    han = "".join(chr(0x4E00 + 37 * i) for i in range(120))
    left = left_by_passages(docs_of([f"前文{han}", f"別的開頭說{han}結尾"]))
    assert len(left[0]) == 122 and len(left[1]) < 57


def test_a_run_of_51_words_inside_a_sentence_is_found(docs_of):
    run = " ".join(f"word{i}" for i in range(51))
    texts = [f"one {run} two three", *(f"{'x%d ' % n * 1}{' '.join(f'y{n}{j}' for j in range(n))} {run} z{n} and on" for n in range(1, 30))]
    left = left_by_passages(docs_of(texts))
    assert left[0] == texts[0]
    for d, text in enumerate(texts[1:], 1):
        assert len(text.split()) - len(left[d].split()) >= substrings.SPAN


def test_one_word_over_and_over_keeps_its_first_window(docs_of):
    left = left_by_passages(docs_of(["same " * 500, "same " * 500 + "end"]))
    assert len(left[0].split()) >= substrings.SPAN and left[1].split()[-1] == "end" and len(left[1].split()) <= 51


def test_windows_keep_one_in_each_stretch():
    texts = ["a b " * 300, " ".join(f"t{i}" for i in range(400)), "few words"]
    doc, start, end, h1, h2 = substrings.windows(texts)
    assert set(doc.tolist()) == {0, 1}
    for d in (0, 1):
        at = [texts[d][: s].count(" ") for s in start[doc == d].tolist()]
        assert at[0] < substrings.AHEAD and max(b - a for a, b in zip(at, at[1:], strict=False)) <= substrings.AHEAD
        assert len(at) <= 3 * len(texts[d].split()) / substrings.AHEAD
    for d, s, e in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True):
        assert len(texts[d][s:e].split()) == substrings.SPAN


def brute_passages(texts, run, least=6):
    """Occurrences of repeated pieces in runs, by sets of covered words; texts is (doc_id, text) with ids in order."""
    held = {}
    for row, (doc_id, text) in enumerate(texts):
        pieces = [(k, u, s, e) for k, cut in enumerate((substrings.units, substrings.lines)) for s, e, u in cut(text, least)]
        pieces += [(2, (h, g), s, e) for _, s, e, h, g in zip(*(x.tolist() for x in substrings.windows([text])), strict=True)]
        for kind, key, s, e in pieces:
            held.setdefault((kind, key), []).append((doc_id, s, e, row, kind))
    again = {}
    for places in held.values():
        first = min(places)
        for p in places:
            if p[3] != first[3] or p[1] != first[1]:
                again.setdefault(p[3], []).append((p, first))
    out = []
    for row, found in again.items():
        words = [m.start() for m in re.finditer(r"\S+", texts[row][1])]
        at = [[i for i, w in enumerate(words) if p[1] <= w < p[2]] for p, _ in found]
        covered = set().union(*at)

        def length(i, covered=covered):
            a, b = i, i
            while a - 1 in covered:
                a -= 1
            while b + 1 in covered:
                b += 1
            return b - a + 1

        for (p, first), own in zip(found, at, strict=True):
            start = max(p[1], first[2]) if first[3] == row else p[1]
            if length(own[0]) >= run and start < p[2]:
                out.append((p[0], start, p[2], substrings.KINDS[p[4]], length(own[0])))
    return sorted(out)


@pytest.mark.parametrize("run", [1, substrings.RUN, 40])
def test_runs_of_passages_match_brute_force(corpus, docs_of, run):
    own = [(r.doc_id, r.text) for r in corpus.where("n_chars < 6000").orderBy("doc_id").collect()]
    lines = ["Menu", "Read more about this here today", "All rights reserved", " ".join(f"w{i}" for i in range(60)), "one two three. four five six seven eight nine. ten!"]
    own += [(10**6 + i, "\n".join(lines[(i * 3 + j * j) % 5] if j % 3 else f"own line {i} {j}" for j in range(i % 7 + 2))) for i in range(30)]
    found = substrings.repeated_passages(docs_of([t for _, t in own], [i for i, _ in own]), run=run).collect()
    want = brute_passages(own, run)
    assert want and sorted((r.doc_id, r.start, r.end, r.kind, r.run_words) for r in found) == want


def test_lone_short_lines_stay_where_runs_are_asked_for(docs_of):
    texts = ["Menu\nown words of the first\nAll rights reserved", "Menu\nother words of the second\nAll rights reserved", None, ""]
    assert substrings.repeated_passages(docs_of(texts), run=substrings.RUN).count() == 0
    assert [r.words for r in substrings.repeated_passages(docs_of(texts)).orderBy("start").collect()] == [1, 3]
    han = "".join(chr(0x4E00 + 37 * i) for i in range(20))
    assert [r.words for r in substrings.repeated_passages(docs_of([han, f"前\n{han}"]), run=substrings.RUN).collect()] == [20]
