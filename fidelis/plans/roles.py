"""The engine's roles played by the available tables, as DataFrames and as the same relations in SQL.

Candidates are orders, readings their line items by rank, outputs the turns of conversations dressed as replies
in several styles, entries the labelled documents, images the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelis.functions import text
from fidelis.operators import conditions

OPTIONS = ("cigarette", "cigar", "pipe", "pen")
#: Patterns that the available texts can hit, in place of the abstention registry, which they can't.
HITS = (r"^\s*$", "thea", "quel")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def readings(spark: SparkSession, d: str) -> DataFrame:
    """(instance, regime, scores): regime is the rank within an order, as line numbers repeat.

    The key is renamed below the window, so that what groups by it later needs no second shuffle.
    """
    order = Window.partitionBy("instance").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    scores = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 12.5)
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "instance")
    return rows.select("instance", F.row_number().over(order).cast("long").alias("regime"), scores.alias("scores"))


READINGS = """readings AS (SELECT l_orderkey AS instance, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
 l_extendedprice, l_quantity, l_discount, l_tax) AS regime, [l_quantity / 50, l_discount * 10, l_tax * 12.5] AS scores FROM lineitem)"""


def folded(spark: SparkSession, d: str) -> DataFrame:
    """One row for each instance that has readings: flips, hflip_held and max_drop. The baseline is a function of the
    key, so readings are folded before they meet candidates."""
    with_base = readings(spark, d).withColumn("baseline", F.col("instance") % 3)
    return conditions.fold_readings(with_base, "instance", F.max(F.get("scores", F.lit(2))).alias("max_drop"))


FOLDED = READINGS + """, marked AS (SELECT *, scores[instance % 3 + 1] >= list_max(scores) AS held FROM readings),
folded AS (SELECT instance, count(*) FILTER (WHERE regime <= 4) AS n_destructive, count(*) FILTER (WHERE regime <= 4 AND NOT held) AS n_flips,
 CASE WHEN count(*) FILTER (WHERE regime <= 4) >= 4 THEN count(*) FILTER (WHERE regime <= 4 AND NOT held) END AS flip_count,
 bool_or(held) FILTER (WHERE regime = 5) AS hflip_held, max(scores[3]) AS max_drop FROM marked GROUP BY instance)"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the stand-ins of the text gates and of the drift."""
    o = F.col("o_orderkey")
    code = (
        F.when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (o % 3 == 0), "E1").when((F.col("o_orderpriority") == "5-LOW") & (o % 4 == 0), "E2")
        .when(o % 50 == 0, "E3")
    )
    return table(spark, d, "orders").select(o.alias("instance"), (F.col("o_custkey") % 4).alias("generator"), "o_totalprice", code.alias("e_code"), ((o * 7919) % 100).alias("drift"))


CANDIDATES = """candidates AS (SELECT o_orderkey AS instance, o_custkey % 4 AS generator, o_totalprice, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 3 = 0 THEN 'E1'
 WHEN o_orderpriority = '5-LOW' AND o_orderkey % 4 = 0 THEN 'E2' WHEN o_orderkey % 50 = 0 THEN 'E3' END AS e_code, (o_orderkey * 7919) % 100 AS drift FROM orders)"""

K, FLOOR, THETA = 3, 0.8, 45


def resolved(spark: SparkSession, d: str) -> DataFrame:
    both = candidates(spark, d).join(folded(spark, d), "instance", "left")
    verdict = conditions.condition_a(F.col("flip_count"), K)
    outcome = conditions.resolve(F.col("e_code"), verdict, F.col("max_drop") >= FLOOR, F.coalesce("hflip_held", F.lit(False)), F.col("drift") >= THETA)
    return both.withColumn("res", outcome)


RESOLVED = FOLDED + ", " + CANDIDATES + """, resolved AS (SELECT c.*, f.flip_count, f.hflip_held, f.max_drop, CASE WHEN e_code IS NOT NULL THEN e_code WHEN flip_count IS NULL THEN 'E4'
 WHEN flip_count < 3 THEN CASE WHEN coalesce(hflip_held, false) THEN 'S1' ELSE 'E6' END WHEN NOT coalesce(max_drop >= 0.8, false) THEN 'E5'
 WHEN NOT coalesce(hflip_held, false) THEN 'E6' WHEN drift >= 45 THEN 'S3' ELSE 'S2' END AS res FROM candidates c LEFT JOIN folded f USING (instance))"""


def options() -> Column:
    return F.array(*map(F.lit, OPTIONS))


def outputs(spark: SparkSession, d: str) -> DataFrame:
    """(instance, text, raw, options): each turn as a reply in one of eight styles."""
    t, said = F.col("text"), F.lit("\nRationale: ")
    styles = [
        F.concat(F.lit("A. cigar"), said, t), F.concat(F.lit("b)\nRationale:"), t), F.concat(F.lit("C\n"), t), F.concat(F.lit(" Pen. "), said, t),
        F.concat(F.lit("E. something"), said, t), F.concat(F.lit("<think>"), t, F.lit("</think>\n<answer>B: x</answer> Rationale: "), t), F.concat(F.lit("<think>"), t), t,
    ]
    pick = (F.col("conv_id") * 7 + F.col("turn")) % 8
    raw = F.when(pick == 0, styles[0])
    for i, s in enumerate(styles[1:], 1):
        raw = raw.when(pick == i, s)
    return table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("instance"), "conv_id", "turn", "text", raw.alias("raw"), options().alias("options"))


OUTPUTS = """outputs AS (SELECT conv_id * 100 + turn AS instance, conv_id, turn, text, CASE (conv_id * 7 + turn) % 8 WHEN 0 THEN 'A. cigar' || chr(10) || 'Rationale: ' || text
 WHEN 1 THEN 'b)' || chr(10) || 'Rationale:' || text WHEN 2 THEN 'C' || chr(10) || text WHEN 3 THEN ' Pen. ' || chr(10) || 'Rationale: ' || text
 WHEN 4 THEN 'E. something' || chr(10) || 'Rationale: ' || text WHEN 5 THEN '<think>' || text || '</think>' || chr(10) || '<answer>B: x</answer> Rationale: ' || text
 WHEN 6 THEN '<think>' || text ELSE text END AS raw, ['cigarette', 'cigar', 'pipe', 'pen'] AS options FROM conversations)"""


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{text.SPACE}]+|[{text.SPACE}]+\\z', '', 'g')"


def sql_tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, '[^{text.SPACE}]+'))"


def extracted(spark: SparkSession, d: str) -> DataFrame:
    plain = outputs(spark, d).withColumn("plain", text.strip_think(F.col("raw")))
    return plain.withColumn("answer", text.extract_answer(F.col("plain"), F.col("options"))).withColumn("rationale", text.extract_rationale(F.col("plain")))


EXTRACTED = OUTPUTS + f""", led AS (SELECT *, regexp_replace(raw, '^[{text.SPACE}]+', '') AS lead FROM outputs),
tailed AS (SELECT *, CASE WHEN NOT starts_with(lead, '<think>') THEN lead WHEN instr(lead, '</think>') > 0 THEN substr(lead, instr(lead, '</think>') + 8) END AS tail FROM led),
parts AS (SELECT *, CASE WHEN instr(tail, 'Rationale:') > 0 THEN substr(tail, 1, instr(tail, 'Rationale:') - 1) ELSE tail END AS head,
 CASE WHEN instr(tail, 'Rationale:') > 0 THEN substr(tail, instr(tail, 'Rationale:')) ELSE '' END AS rest FROM tailed),
plained AS (SELECT *, {sql_strip("replace(replace(replace(replace(head, '<|begin_of_box|>', ''), '<|end_of_box|>', ''), '<answer>', ''), '</answer>', '') || rest")} AS plain FROM parts),
lined AS (SELECT *, split_part({sql_strip("plain")}, chr(10), 1) AS line FROM plained),
lettered AS (SELECT *, upper(coalesce(nullif(regexp_extract(line, '^[{text.SPACE}]*([A-Ha-h])[.):]', 1), ''), nullif(regexp_extract(line, '^[{text.SPACE}]*([A-Ha-h])[{text.SPACE}]*\\z', 1), ''))) AS letter,
 lower(regexp_replace({sql_strip("line")}, '[.]+\\z', '')) AS bare FROM lined),
extracted AS (SELECT instance, conv_id, turn, text, raw, options, plain, CASE WHEN letter IS NOT NULL THEN options[ascii(letter) - 64] WHEN list_contains(options, bare) THEN bare END AS answer,
 CASE WHEN instr(plain, 'Rationale:') > 0 THEN nullif({sql_strip("substr(plain, instr(plain, 'Rationale:') + 10)")}, '') END AS rationale FROM lettered)"""


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as corpus entries: truth, prediction and score, generator, dataset, question type and scene."""
    docs = table(spark, d, "documents").drop("text").join(table(spark, d, "labels"), "doc_id")
    n, i = F.col("n_chars"), F.col("doc_id")
    return docs.select(
        i.alias("instance"), F.col("quality").cast("long").alias("truth"), F.col("toxic").cast("long").alias("toxic"), (n >= 1500).cast("long").alias("pred"), n.cast("double").alias("score"),
        (i % 4).alias("generator"), F.col("lang").alias("dataset"), F.concat(F.lit("q"), (n % 5).cast("string")).alias("qtype"), F.concat_ws("-", "source", (i % 11).cast("string")).alias("scene"),
        F.when(F.col("quality") == 1, "faithful").otherwise("unfaithful").alias("label"),
        F.when(F.col("quality") == 1, F.lit(None).cast("string")).when(F.col("toxic") == 1, "D1").otherwise("D2").alias("reason"),
    )


ENTRIES = """entries AS (SELECT doc_id AS instance, quality::BIGINT AS truth, toxic::BIGINT AS toxic, (n_chars >= 1500)::BIGINT AS pred, n_chars::DOUBLE AS score, doc_id % 4 AS generator, lang AS dataset,
 'q' || (n_chars % 5) AS qtype, source || '-' || (doc_id % 11) AS scene, CASE WHEN quality = 1 THEN 'faithful' ELSE 'unfaithful' END AS label,
 CASE WHEN quality = 1 THEN NULL WHEN toxic = 1 THEN 'D1' ELSE 'D2' END AS reason FROM documents JOIN labels USING (doc_id))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(instance, baseline, counterfactual): a turn's text and the next turn's."""
    a = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("baseline"))
    b = table(spark, d, "conversations").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("counterfactual"))
    return a.join(b, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("instance"), "conv_id", "turn", "baseline", "counterfactual")


PAIRS = """pairs AS (SELECT a.conv_id * 100 + a.turn AS instance, a.conv_id, a.turn, a.text AS baseline, b.text AS counterfactual
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""

_STOP = "[" + ", ".join("'" + w + "'" for w in text.STOPWORDS) + "]"


def sql_words(x: str) -> str:
    return f"list_filter(list_distinct(regexp_extract_all(lower({x}), '[a-z'']+')), lambda w: NOT list_contains({_STOP}, w))"


def drifts(spark: SparkSession, d: str) -> DataFrame:
    """(instance, pos, targeted, control): word drift to the next turn, and drift scaled down as the control's."""
    base = pairs(spark, d).withColumn("targeted", text.jaccard_drift(F.col("baseline"), F.col("counterfactual")))
    return base.select("instance", F.col("conv_id").alias("pos"), "targeted", (F.col("targeted") * ((F.col("instance") % 7) / 10.0)).alias("control"))


DRIFTS = PAIRS + f""", worded AS (SELECT *, {sql_words("baseline")} AS p, {sql_words("counterfactual")} AS q FROM pairs),
drifts AS (SELECT instance, conv_id AS pos, targeted, targeted * ((instance % 7) / 10.0::DOUBLE) AS control FROM (SELECT *, CASE WHEN len(list_distinct(list_concat(p, q))) = 0 THEN 0.0::DOUBLE
 ELSE 1 - len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q))) END AS targeted FROM worded))"""


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """(instance, height, width, top, left, bottom, right): an evidence box on an image for each part."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    sized = table(spark, d, "part").select(k.alias("instance"), (64 + k % 200).alias("height"), (96 + (k * 7) % 150).alias("width"), s.alias("s"))
    h, w, i = F.col("height"), F.col("width"), F.col("instance")
    sized = sized.withColumn("top", (i * 3) % (h - 20)).withColumn("left", (i * 5) % (w - 20))
    return sized.withColumn("bottom", F.least(h, F.col("top") + 10 + F.col("s") * 2)).withColumn("right", F.least(w, F.col("left") + 10 + F.col("s") * 2)).drop("s")


BOXES = """boxes AS (SELECT instance, height, width, top, "left", least(height, top + 10 + s * 2) AS bottom, least(width, "left" + 10 + s * 2) AS "right" FROM (SELECT *, (instance * 3) % (height - 20) AS top,
 (instance * 5) % (width - 20) AS "left" FROM (SELECT p_partkey AS instance, 64 + p_partkey % 200 AS height, 96 + (p_partkey * 7) % 150 AS width, p_size::BIGINT AS s FROM part)))"""


def drops(spark: SparkSession, d: str) -> DataFrame:
    """(instance, height, width, row, col, drop): a sweep of 64 cells over each part's image."""
    from fidelis.operators.grid import sweep

    images = table(spark, d, "part").select(F.col("p_partkey").alias("instance"), F.col("p_size").cast("long").alias("s"), (64 + F.col("p_partkey") % 200).alias("height"), (96 + (F.col("p_partkey") * 7) % 150).alias("width"))
    return sweep(images).withColumn("drop", ((F.col("instance") * 31 + F.col("cell") * F.col("s") * 17) % 97).cast("double") / 100)


DROPS = """drops AS (SELECT p_partkey AS instance, 64 + p_partkey % 200 AS height, 96 + (p_partkey * 7) % 150 AS width, cell // 8 AS "row", cell % 8 AS col,
 ((p_partkey * 31 + cell * p_size * 17) % 97)::DOUBLE / 100 AS "drop" FROM part, range(64) AS t(cell))"""


def predicted(spark: SparkSession, d: str) -> DataFrame:
    """Entries with a split from their scene."""
    from fidelis.operators.assemble import assign_splits

    return assign_splits(entries(spark, d), [3], ["es"], ["q4"])


def sql_uniform(*keys: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


PREDICTED = ENTRIES + f""", closing AS (SELECT *, max((qtype IN ('q4'))::INT) OVER (PARTITION BY scene) AS closed, {sql_uniform("'split'", "scene")} AS u FROM entries),
predicted AS (SELECT * EXCLUDE (closed, u), CASE WHEN generator = 3 THEN 'ood-model' WHEN dataset = 'es' THEN 'ood-dataset' WHEN qtype = 'q4' THEN 'ood-qtype' WHEN closed = 1 THEN 'iid-test'
 WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'validation' ELSE 'iid-test' END AS split FROM closing)"""

