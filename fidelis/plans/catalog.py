"""queries() and oracle_sql() of the engine's own operators, one entry for each operator or family of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fidelis.functions import drift, stats, text
from fidelis.operators import assemble, assurance, calibrate, conditions, descriptives, evaluate, gates, grid, identity, images, ingest, ledger, matching, merkle, overlap, run, scoring, views
from fidelis.plans import roles as R
from fidelis.sources import log_source
from fidelis.sources.scratch import Scratch
from fidelis.streaming import artifacts
from fidelis.streaming import ledger_stream as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- decisions ---------------------------------------------------------------------------------------------


@query(f"WITH {R.RESOLVED} SELECT res, count(*) AS n, round(avg(o_totalprice), 2) AS avg_total FROM resolved GROUP BY res")
def resolve_candidates(spark, d):
    return R.resolved(spark, d).groupBy("res").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("avg_total"))


@query(f"WITH {R.FOLDED} SELECT instance, n_destructive, flip_count FROM folded")
def condition_a_flips(spark, d):
    return conditions.fold_readings(R.readings(spark, d).withColumn("baseline", F.col("instance") % 3)).select("instance", "n_destructive", "flip_count")


@query(f"WITH {R.FOLDED} SELECT k, CASE WHEN flip_count IS NULL THEN 'INDETERMINATE' WHEN flip_count >= k THEN 'TRUE' ELSE 'FALSE' END AS verdict, count(*) AS n FROM folded, (VALUES (2), (3)) AS g(k) GROUP BY ALL")
def condition_a_verdicts(spark, d):
    folded = R.folded(spark, d)
    both = [folded.select(F.lit(k).alias("k"), conditions.condition_a(F.col("flip_count"), k).alias("verdict")) for k in conditions.K_GRID]
    return both[0].unionAll(both[1]).groupBy("k", "verdict").agg(F.count("*").alias("n"))


@query(f"WITH {R.READINGS} SELECT instance, regime, list_position(scores, list_max(scores))::BIGINT - 1 AS best FROM readings")
def argmax_first(spark, d):
    return R.readings(spark, d).select("instance", "regime", stats.argmax_first(F.col("scores")).alias("best"))


@query(f"WITH {R.CANDIDATES} SELECT generator, count(*) FILTER (WHERE drift >= 45) AS tracking, count(*) AS n FROM candidates GROUP BY generator")
def condition_b_tracks(spark, d):
    drift = R.candidates(spark, d).withColumn("drift", F.col("drift").cast("double")).withColumn("theta", F.lit(float(R.THETA)))
    return conditions.condition_b(drift, "drift", "theta").groupBy("generator").agg(F.count_if("tracks").alias("tracking"), F.count("*").alias("n"))


_LABEL = "CASE WHEN res IN ('S1', 'S2') THEN 'unfaithful' WHEN res = 'S3' THEN 'faithful' END AS label, CASE res WHEN 'S1' THEN 'D1' WHEN 'S2' THEN 'D2' END AS reason"


@query(f"WITH {R.RESOLVED} SELECT {_LABEL}, count(*) AS n FROM resolved GROUP BY ALL")
def label_projection(spark, d):
    res = F.col("res")
    return R.resolved(spark, d).select(conditions.label_of(res).alias("label"), conditions.reason_of(res).alias("reason")).groupBy("label", "reason").agg(F.count("*").alias("n"))


@query(f"WITH {R.RESOLVED} SELECT count(*) AS sealed, count(*) FILTER (WHERE res LIKE 'E%') AS routed FROM resolved")
def seal_check(spark, d):
    res = R.resolved(spark, d).withColumn("spec_versions", F.array(F.lit("1.0")))
    code = F.when(F.col("res").startswith("E"), F.col("res"))
    rows = res.select("spec_versions", code.alias("e_code"), F.when(code.isNull(), F.col("res")).alias("state"), conditions.label_of(F.col("res")).alias("label"), conditions.reason_of(F.col("res")).alias("reason_code"))
    return rows.agg(F.count_if(conditions.legal_seal()).alias("sealed"), F.count_if(F.col("e_code").isNotNull()).alias("routed"))


@query(f"WITH {R.RESOLVED} SELECT res AS e_code, count(*) AS n FROM resolved WHERE res LIKE 'E%' GROUP BY res")
def routed_counts(spark, d):
    return R.resolved(spark, d).where(F.col("res").startswith("E")).groupBy(F.col("res").alias("e_code")).agg(F.count("*").alias("n"))


@query("""WITH o AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 31 <> 0 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 37 = 0 UNION ALL SELECT -1), n AS (SELECT k, count(*) AS n FROM o GROUP BY k)
SELECT count(*) FILTER (WHERE n IS NULL) AS unresolved, count(*) FILTER (WHERE o_orderkey IS NULL) AS unknown, count(*) FILTER (WHERE n > 1) AS repeated, count(*) FILTER (WHERE o_orderkey IS NOT NULL AND n = 1) AS resolved FROM orders FULL JOIN n ON o_orderkey = k""")
def resolution_totality(spark, d):
    """Outcomes of which some are missing, some are there twice and one has no candidate."""
    res = R.resolved(spark, d)
    once, twice = res.where("instance % 31 <> 0").select("instance"), res.where("instance % 37 = 0").select("instance")
    outcomes = once.unionAll(twice).unionAll(spark.createDataFrame([(-1,)], "instance long"))
    return assemble.totality(R.candidates(spark, d), outcomes, "instance")


# --- text and gates ----------------------------------------------------------------------------------------


@query(f"WITH {R.EXTRACTED} SELECT instance, answer FROM extracted")
def mc_extract(spark, d):
    return R.extracted(spark, d).select("instance", "answer")


@query(f"WITH {R.EXTRACTED} SELECT instance, rationale FROM extracted")
def rationale_extract(spark, d):
    return R.extracted(spark, d).select("instance", "rationale")


@query(f"WITH {R.EXTRACTED} SELECT instance, plain FROM extracted")
def think_strip(spark, d):
    return R.extracted(spark, d).select("instance", "plain")


@query("""SELECT p_partkey AS instance, 'Question: ' || p_name || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || chr(10)
 || 'Answer with the letter of the correct option on the first line, then explain your reasoning after "Rationale:".' AS prompt FROM part""")
def prompt_render(spark, d):
    return R.table(spark, d, "part").select(F.col("p_partkey").alias("instance"), text.render_prompt(F.col("p_name"), F.array("p_brand", "p_type")).alias("prompt"))


@query(f"WITH {R.EXTRACTED} SELECT instance, sha256(to_json({{'chosen_answer': answer, 'rationale': rationale}})) AS digest FROM extracted")
def baseline_digest(spark, d):
    return R.extracted(spark, d).select("instance", identity.baseline_digest(F.col("answer"), F.col("rationale")).alias("digest"))


@query(f"WITH {R.EXTRACTED} SELECT count(*) AS n, count(*) FILTER (WHERE instance % 7 <> 0) AS verified, count(*) FILTER (WHERE instance % 7 = 0) AS altered FROM extracted")
def digest_verify(spark, d):
    """Rationales that were altered after their digest was taken, one in seven, against those that weren't."""
    rows = R.extracted(spark, d).withColumn("digest", identity.baseline_digest(F.col("answer"), F.col("rationale")))
    later = rows.withColumn("rationale", F.when(F.col("instance") % 7 == 0, F.concat(F.coalesce("rationale", F.lit("")), F.lit("!"))).otherwise(F.col("rationale")))
    same = identity.digest_holds("answer", "rationale", "digest")
    return later.agg(F.count("*").alias("n"), F.count_if(same).alias("verified"), F.count_if(~same).alias("altered"))


@query("""SELECT doc_id, to_json({'dataset': lang, 'record_id': doc_id::VARCHAR})::VARCHAR AS source, to_json({'dtype': source, 'name': lang})::VARCHAR AS generator FROM documents""")
def canonical_keys(spark, d):
    docs = R.table(spark, d, "documents")
    components = F.create_map(F.lit("name"), "lang", F.lit("dtype"), "source")
    return docs.select("doc_id", identity.source_key(F.col("lang"), F.col("doc_id").cast("string")).alias("source"), identity.generator_key(components).alias("generator"))


@query("SELECT conv_id, turn, contains(lower(text), ' left') OR contains(lower(text), ' right') OR contains(lower(text), 'left ') OR contains(lower(text), 'right ') AS lateral FROM conversations")
def spatial_flag(spark, d):
    return R.table(spark, d, "conversations").select("conv_id", "turn", text.spatial_lateral(F.col("text")).alias("lateral"))


@query(f"WITH {R.EXTRACTED} SELECT instance, coalesce(list_position(list_transform(options, lambda o: lower(trim(o))), lower(trim(answer))), 0)::BIGINT - 1 AS baseline FROM extracted WHERE answer IS NOT NULL")
def baseline_index(spark, d):
    return R.extracted(spark, d).where("answer is not null").select("instance", descriptives.baseline_index(F.col("answer"), F.col("options")).alias("baseline"))




_HIT = " OR ".join("regexp_matches({0}, '(?i)" + p + "')" for p in R.HITS)


@query(f"SELECT doc_id, {_HIT.format('text')} AS hit FROM documents")
def registry_scan(spark, d):
    return R.table(spark, d, "documents").select("doc_id", text.registry_hit(F.col("text"), R.HITS).alias("hit"))


_SAID = "CASE WHEN (conv_id * 7 + turn) % 24 < 15 THEN [" + ", ".join("'" + p.replace("'", "''").replace(r"^\s*$", " ") + "'" for p in text.ABSTENTIONS) + "][(conv_id * 7 + turn) % 24 + 1] || CASE WHEN (conv_id * 7 + turn) % 24 > 0 THEN ', ' || text ELSE '' END ELSE text END"
_REGISTERED = " OR ".join("regexp_matches(said, '(?i)" + p.replace("'", "''") + "')" for p in text.ABSTENTIONS)


@query(f"SELECT conv_id, turn, {_REGISTERED} AS hit FROM (SELECT conv_id, turn, {_SAID} AS said FROM conversations)")
def registered_patterns(spark, d):
    """The whole registry over turns of which most begin with one of its phrases or are blank."""
    pick = (F.col("conv_id") * 7 + F.col("turn")) % 24
    phrases = F.array(*(F.lit(" " if p == r"^\s*$" else p) for p in text.ABSTENTIONS))
    said = F.when(pick < 15, F.concat(F.get(phrases, pick.cast("int")), F.when(pick > 0, F.concat(F.lit(", "), "text")).otherwise(F.lit("")))).otherwise(F.col("text"))
    return R.table(spark, d, "conversations").select("conv_id", "turn", text.registry_hit(said).alias("hit"))


_GATED = (
    f"{R.EXTRACTED}, gated AS (SELECT *, coalesce({R.sql_strip('rationale')} <> '' AND len(list_filter(options, lambda o: lower(trim(o)) = lower(trim(answer)))) = 1, false) AS p1, "
    f"coalesce(NOT ({_HIT.format('rationale')}) AND {R.sql_tokens('rationale')} >= 5 AND lower(regexp_replace({R.sql_strip('rationale')}, '[.]+\\z', '')) <> lower(regexp_replace({R.sql_strip('answer')}, '[.]+\\z', '')), false) AS p2, turn % 3 <> 2 AS p3 FROM extracted), "
    "coded AS (SELECT *, CASE WHEN NOT p1 THEN 'E1' WHEN NOT p2 THEN 'E2' WHEN NOT p3 THEN 'E3' END AS e_code, CASE WHEN NOT p1 THEN 1 WHEN NOT p2 THEN 2 ELSE 3 END AS reached FROM gated)"
)


def _gated(spark, d):
    rows = R.extracted(spark, d)
    answer, rationale, options = F.col("answer"), F.col("rationale"), F.col("options")
    p3 = gates.in_scope(F.lit(True), options, F.concat(F.lit("s"), (F.col("turn") % 3).cast("string")), ["s0", "s1"])
    return rows.select("*", gates.complete(answer, rationale, options).alias("p1"), gates.bona_fide(answer, rationale, R.HITS).alias("p2"), p3.alias("p3")).withColumn("gate", gates.cascade(F.col("p1"), F.col("p2"), F.col("p3")))


@query(f"WITH {_GATED} SELECT e_code, reached::BIGINT AS gates, count(*) AS n FROM coded GROUP BY ALL")
def p_gate_cascade(spark, d):
    return _gated(spark, d).groupBy("gate.e_code", F.size("gate.gates").cast("long").alias("gates")).agg(F.count("*").alias("n"))


@query(f"WITH {_GATED} SELECT count(*) FILTER (WHERE p1) AS complete, count(*) FILTER (WHERE p2) AS bona_fide, count(*) FILTER (WHERE p3) AS in_scope FROM coded")
def p_gates_each(spark, d):
    return _gated(spark, d).agg(F.count_if("p1").alias("complete"), F.count_if("p2").alias("bona_fide"), F.count_if("p3").alias("in_scope"))


_COHERENT = f"""{R.PAIRS}, counted AS (SELECT *, {R.sql_tokens("baseline")} AS nb, {R.sql_tokens("counterfactual")} AS nc FROM pairs),
cohered AS (SELECT *, CASE WHEN {R.sql_strip("counterfactual")} = '' THEN 'empty' WHEN nc < greatest(5, ceil(0.25 * nb)) OR nc > floor(4.0 * nb) THEN 'length'
 WHEN {_HIT.format("counterfactual")} THEN 'abstention' ELSE 'pass' END AS coherence FROM counted)"""


@query(f"WITH {_COHERENT} SELECT coherence, count(*) AS n FROM cohered GROUP BY coherence")
def coherence_screen(spark, d):
    return R.pairs(spark, d).select(gates.coherence(F.col("baseline"), F.col("counterfactual"), R.HITS).alias("coherence")).groupBy("coherence").agg(F.count("*").alias("n"))


@query(f"""WITH {_COHERENT}, {R.DRIFTS.split(", worded AS")[0].replace("pairs AS", "pairs2 AS", 1)}, worded AS {R.DRIFTS.split(", worded AS", 1)[1]}, sided AS (SELECT c.instance, c.turn % 2 = 0 AS a_true, c.turn % 3 <> 0 AS held, contains(lower(c.baseline), 'the ') AS is_lateral,
 c.coherence = 'pass' AS coherent, d.control, c.instance % 5 <> 0 AS applicable FROM cohered c JOIN drifts d USING (instance)),
stated AS (SELECT *, CASE WHEN is_lateral THEN 'inapplicable' WHEN held THEN 'pass' ELSE 'fail' END AS hflip, CASE WHEN a_true THEN CASE WHEN coherent THEN 'pass' ELSE 'fail' END END AS coh,
 CASE WHEN a_true THEN CASE WHEN NOT applicable THEN 'inapplicable' WHEN control < 0.4 THEN 'pass' ELSE 'fail' END END AS edit FROM sided)
SELECT a_true, hflip <> 'fail' AND coalesce(coh <> 'fail', true) AND coalesce(edit <> 'fail', true) AS holds, count(*) AS n FROM stated GROUP BY ALL""")
def p6_controls(spark, d):
    rows = R.pairs(spark, d).join(R.drifts(spark, d).select("instance", "control"), "instance")
    coherent = gates.coherence(F.col("baseline"), F.col("counterfactual"), R.HITS) == "pass"
    lateral = F.lower("baseline").contains("the ")
    results = gates.controls(F.col("turn") % 2 == 0, F.col("turn") % 3 != 0, lateral, F.lit(True), F.lit(True), coherent, F.col("control"), F.col("instance") % 5 != 0, F.lit(0.4))
    return rows.groupBy((F.col("turn") % 2 == 0).alias("a_true"), gates.controls_hold(results).alias("holds")).agg(F.count("*").alias("n"))


_SCORE = "CASE WHEN instance % 23 <> 0 THEN list_transform(range(1, 5 - (instance % 19 = 0)::INT), lambda i: ((length(text) * {0} + i * {1}) % {2})::DOUBLE) END"
_READ = f""", read AS (SELECT *, conv_id % 6 AS style, {_SCORE.format(1, 3, 7)} AS letter_scores, {_SCORE.format(5, 4, 9)} AS text_scores, CASE WHEN turn % 5 <> 0 THEN conv_id % 5 END AS gold, length(raw) / 100.0::DOUBLE AS t_generate, CASE WHEN turn % 3 <> 0 THEN turn / 4.0::DOUBLE END AS t_score FROM extracted)"""
_BEST = "lower(options[list_position({0}, list_max({0}))]) = lower(answer)"
_SHARE = "round(count(*) FILTER (WHERE answer IS NOT NULL AND {0}) / greatest(1, count(answer))::DOUBLE, 3)"
_GOLD = "count(*) FILTER (WHERE answer = options[gold + 1]) AS gold_correct"


def _read_outputs(spark, d):
    """Extracted replies with scores of options by letter and by text, some of them missing or short, a right option, that may be none, and times."""
    i, n = F.col("instance"), F.length("text")
    places = F.sequence(F.lit(1), F.when(i % 19 == 0, 3).otherwise(4))
    score = lambda a, b, m: F.when(i % 23 != 0, F.transform(places, lambda x: ((n * a + x * b) % m).cast("double")))
    return R.extracted(spark, d).withColumns({
        "style": F.col("conv_id") % 6, "letter_scores": score(1, 3, 7), "text_scores": score(5, 4, 9), "gold": F.when(F.col("turn") % 5 != 0, F.col("conv_id") % 5),
        "t_generate": F.length("raw") / 100.0, "t_score": F.when(F.col("turn") % 3 != 0, F.col("turn") / 4.0),
    })


@query(f"""WITH {R.EXTRACTED}{_READ} SELECT style, count(*) AS n, count(answer) AS parsed, count(*) FILTER (WHERE rationale <> '') AS with_rationale, count(*) FILTER (WHERE starts_with(lead, '<think>')) AS opened,
 count(*) FILTER (WHERE starts_with(lead, '<think>') AND NOT contains(raw, '</think>')) AS unclosed, count(*) FILTER (WHERE contains(raw, 'Rationale:')) AS marker_compliance, {_SHARE.format(_BEST.format('letter_scores'))} AS agreement, {_GOLD},
 round(coalesce(sum(t_generate), 0) / count(*), 1) AS mean_t_generate, round(coalesce(sum(t_score), 0) / count(*), 1) AS mean_t_score FROM (SELECT *, regexp_replace(raw, '^[{text.SPACE}]+', '') AS lead FROM read) GROUP BY style""")
def extraction_quality(spark, d):
    return run.extraction_quality(_read_outputs(spark, d).withColumnRenamed("letter_scores", "scores"), ["style"])


@query(f"""WITH {R.EXTRACTED}{_READ}, s AS (SELECT style, count(*) AS n, count(answer) AS parsed, {_SHARE.format(_BEST.format('letter_scores'))} AS letter_agreement, {_SHARE.format(_BEST.format('text_scores'))} AS text_agreement, {_GOLD} FROM read GROUP BY style)
SELECT *, CASE WHEN letter_agreement > text_agreement THEN 'letter' WHEN letter_agreement < text_agreement THEN 'text' END AS better FROM s""")
def scorer_diagnostic(spark, d):
    return run.scorer_diagnostic(_read_outputs(spark, d), ["style"])


# --- ingest, identity, ledger ------------------------------------------------------------------------------


def _raw(spark, d):
    c = F.col("conv_id") * 100 + F.col("turn")
    m = lambda n, v: F.when(c % 11 == n, v)
    return R.table(spark, d, "conversations").select(
        m(0, F.lit("")).otherwise(c.cast("string")).alias("question_id"), m(1, F.lit(None).cast("string")).otherwise(F.col("turn").cast("string")).alias("image_id"),
        m(2, F.lit(" 　 ")).otherwise(F.concat(F.lit("  "), F.col("text"), F.lit("\n"))).alias("question"),
        m(3, F.array(F.lit("only"))).when(c % 11 == 4, F.array(F.lit("a"), F.lit(" \t"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("choices"),
        m(5, F.lit(9)).when(c % 11 == 6, F.lit(-1)).otherwise(F.lit(1)).alias("correct_choice_idx"),
    )


_REASON = """CASE (conv_id * 100 + turn) % 11 WHEN 0 THEN 'missing question_id' WHEN 1 THEN 'missing image_id' WHEN 2 THEN 'empty question' WHEN 3 THEN 'malformed choices (need >=2 options)'
 WHEN 4 THEN 'empty option text' WHEN 5 THEN 'gold index missing or out of range' WHEN 6 THEN 'gold index missing or out of range' END"""


@query(f"SELECT CASE WHEN (conv_id * 100 + turn) % 11 = 0 THEN '<missing question_id>' ELSE (conv_id * 100 + turn)::VARCHAR END AS raw_record_id, 'pool' AS dataset, {_REASON} AS reason FROM conversations WHERE {_REASON} IS NOT NULL")
def normalize_exclusions(spark, d):
    return ingest.exclusions(ingest.normalize(_raw(spark, d), "pool"))


@query(f"SELECT (conv_id * 100 + turn)::VARCHAR AS record_id, 'coco/' || turn AS image_ref, {R.sql_strip('text')} AS question, 1 AS gold_answer_idx FROM conversations WHERE {_REASON} IS NULL")
def normalize_records(spark, d):
    return ingest.records(ingest.normalize(_raw(spark, d), "pool")).select("record_id", "image_ref", "question", "gold_answer_idx")


@query("SELECT count(*) AS n, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR)) AS digest FROM documents")
def pool_digest(spark, d):
    return identity.ids_digest(R.table(spark, d, "documents"), "doc_id")


@query("SELECT o_orderkey AS instance, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders")
def pool_positions(spark, d):
    return identity.assign_position(R.table(spark, d, "orders").select(F.col("o_orderkey").alias("instance")), "instance")


@query("SELECT doc_id, pos, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS partner FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents)")
def derangement(spark, d):
    return identity.derangement(identity.assign_position(R.table(spark, d, "documents").select("doc_id"), "doc_id"), "doc_id")


@query("SELECT CASE WHEN pos % 2 = 0 THEN 'calibration' ELSE 'verification' END AS fold, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (SELECT n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) GROUP BY 1")
def fold_parity(spark, d):
    placed = identity.assign_position(R.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return placed.groupBy(calibrate.fold(F.col("pos")).alias("fold")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT doc_id, pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) WHERE pos BETWEEN 20 AND 69")
def shard_slice(spark, d):
    from fidelis.sources.readers import shard

    return shard(identity.assign_position(R.table(spark, d, "documents").select("doc_id"), "doc_id"), 20, 70)


@query("SELECT doc_id, rn FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents WHERE n_chars >= 500) WHERE rn > 30 AND rn <= 60")
def valid_window(spark, d):
    placed = identity.assign_position(R.table(spark, d, "documents").where("n_chars >= 500").select("doc_id"), "doc_id")
    return placed.where("pos >= 30 and pos < 60").select("doc_id", (F.col("pos") + 1).alias("rn"))


@query("SELECT o_custkey % 10 AS slot, count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT user_id FROM events) GROUP BY 1")
def resume_antijoin(spark, d):
    done = R.table(spark, d, "events").select(F.col("user_id").alias("o_orderkey")).distinct()
    return ledger.uncommitted(R.table(spark, d, "orders"), done, "o_orderkey").groupBy((F.col("o_custkey") % 10).alias("slot")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(l.doc_id) AS present, count(*) - count(l.doc_id) AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def missing_payloads(spark, d):
    both = ledger.with_payloads(R.table(spark, d, "documents").select("doc_id"), R.table(spark, d, "labels"), "doc_id")
    return both.agg(F.count("*").alias("n"), F.count_if("present").alias("present"), F.count_if(~F.col("present")).alias("missing"))


@query("SELECT event_id::VARCHAR || '::output_tuple' AS key, event_id::VARCHAR AS instance FROM events")
def ledger_keys(spark, d):
    key = ledger.output_key(F.col("event_id"))
    return R.table(spark, d, "events").select(key.alias("key"), ledger.instance_of(key).alias("instance"))


@query("SELECT count(*) AS keys, sum(1)::BIGINT AS commits FROM events")
def ledger_no_duplicates(spark, d):
    return ledger.no_duplicates(R.table(spark, d, "events"), "event_id").agg(F.count("*").alias("keys"), F.sum("commits").alias("commits"))


@query("SELECT user_id, count(*) AS commits FROM events GROUP BY user_id HAVING count(*) > 1")
def ledger_duplicates(spark, d):
    return ledger.duplicates(R.table(spark, d, "events"), "user_id")


@query("SELECT count(*) AS comparable, count(*) FILTER (WHERE a.n_chars IS NOT DISTINCT FROM CASE WHEN a.doc_id % 9 <> 0 THEN a.n_chars END) AS identical FROM documents a")
def determinism_check(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "n_chars")
    return ledger.determinism(docs, docs.withColumn("n_chars", F.when(F.col("doc_id") % 9 != 0, F.col("n_chars"))), "doc_id", ["n_chars"])


# --- calibration -------------------------------------------------------------------------------------------


@query(f"""WITH {R.DRIFTS}, m AS (SELECT count(*) AS n, (median(targeted) + median(control)) / 2 AS theta, quantile_cont(targeted, 0.75) - quantile_cont(targeted, 0.25) AS iqr FROM drifts),
s AS (SELECT avg((targeted >= theta)::INT) AS ts, avg((control >= theta)::INT) AS cs FROM drifts, m)
SELECT n, round(theta, 6) AS theta, round(iqr, 6) AS targeted_iqr, round(ts, 6) AS targeted_share, round(cs, 6) AS control_share, theta > 0 AND iqr >= 0.05 AND ts >= 0.25 AND cs <= 0.1 AS viable FROM m, s""")
def theta_midpoint(spark, d):
    out = calibrate.theta_midpoint(R.drifts(spark, d), least=10)
    return out.select("n", "viable", *(F.round(c, 6).alias(c) for c in ("theta", "targeted_iqr", "targeted_share", "control_share")))


@query(f"WITH {R.DRIFTS} SELECT round(quantile_cont(control, 0.9), 6) AS theta FROM drifts WHERE pos % 2 = 0")
def theta_p90(spark, d):
    return calibrate.theta_p90(R.drifts(spark, d).where(calibrate.fold(F.col("pos")) == "calibration")).select(F.round("theta", 6).alias("theta"))


@query(f"WITH {R.FOLDED} SELECT round(quantile_cont(max_drop, 0.1), 6) AS floor FROM folded WHERE instance % 2 = 0")
def saliency_floor(spark, d):
    return calibrate.saliency_floor(R.folded(spark, d).where("instance % 2 = 0")).select(F.round("floor", 6).alias("floor"))


_AGREE = f"{R.FOLDED}, judged AS (SELECT g.k, avg(((f.flip_count >= g.k) = (f.instance % 3 > 0))::INT) AS agreement FROM folded f, (VALUES (2), (3)) AS g(k) WHERE f.flip_count IS NOT NULL GROUP BY g.k)"


@query(f"WITH {_AGREE} SELECT max(k)::BIGINT AS k FROM judged WHERE agreement = (SELECT max(agreement) FROM judged)")
def choose_k_agreement(spark, d):
    known = R.folded(spark, d).where("flip_count is not null")
    rows = known.select("flip_count", "instance", F.explode(F.array(F.lit(2), F.lit(3)).cast("array<bigint>")).alias("k"))
    return calibrate.choose_k_agreement(rows.groupBy("k").agg(F.avg(((F.col("flip_count") >= F.col("k")) == (F.col("instance") % 3 > 0)).cast("double")).alias("agreement")))


@query("""WITH p AS (SELECT event_type, avg((value < 20)::INT) AS p_noise FROM events GROUP BY event_type), t AS (SELECT *, 6 * p_noise**2 * (1 - p_noise)**2 + 4 * p_noise**3 * (1 - p_noise) + p_noise**4 AS t2,
 4 * p_noise**3 * (1 - p_noise) + p_noise**4 AS t3 FROM p) SELECT event_type, round(p_noise, 6) AS p_noise, CASE WHEN t2 <= 0.05 THEN 2 WHEN t3 <= 0.05 THEN 3 END::BIGINT AS k FROM t""")
def choose_k_binomial(spark, d):
    noise = R.table(spark, d, "events").groupBy("event_type").agg(F.avg((F.col("value") < 20).cast("double")).alias("p_noise"))
    return calibrate.choose_k_binomial(noise).withColumn("p_noise", F.round("p_noise", 6))


@query("""SELECT source, count(*) AS n, sum(quality)::BIGINT AS hits, round(greatest(0.0::DOUBLE, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS low,
 round(least(1.0::DOUBLE, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)), 6) AS high
 FROM (SELECT source, quality, count(*) OVER w::DOUBLE AS n, sum(quality) OVER w / (count(*) OVER w)::DOUBLE AS p FROM documents JOIN labels USING (doc_id) WINDOW w AS (PARTITION BY source)) GROUP BY source, n, p""".replace("count(*) OVER w::DOUBLE AS n", "(count(*) OVER w)::DOUBLE AS n").replace("count(*) AS n, sum", "count(*) AS n_docs, sum"))
def wilson(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", "source").join(R.table(spark, d, "labels"), "doc_id")
    rates = docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("quality").alias("hits"))
    ci = stats.wilson(F.col("hits"), F.col("n_docs"))
    return rates.select("source", "n_docs", "hits", F.round(ci["low"], 6).alias("low"), F.round(ci["high"], 6).alias("high"))


_SLICE = "sliced AS (SELECT *, row_number() OVER (ORDER BY instance) - 1 AS pos FROM extracted)"
_SUMS = "count(*) AS n, count(*) FILTER (WHERE answer IS NOT NULL) AS parsed, count(*) FILTER (WHERE answer = 'cigarette') AS agreed"
_PASSED = "round(parsed / n::DOUBLE, 4) AS parseability, coalesce(round(agreed / nullif(parsed, 0)::DOUBLE, 4), 0.0::DOUBLE) AS agreement, parsed / n::DOUBLE >= 0.9 AND coalesce(agreed / nullif(parsed, 0)::DOUBLE, 0) >= 0.6 AS passed"


def _rounded_gate(gate):
    return gate.withColumn("parseability", F.round("parseability", 4)).withColumn("agreement", F.round("agreement", 4))


@query(f"WITH {R.EXTRACTED}, {_SLICE}, g AS (SELECT {_SUMS} FROM sliced WHERE pos < {run.GATE_SLICE}) SELECT n, {_PASSED} FROM g")
def calibration_gate(spark, d):
    """The gate over its slice: the first records by assigned position."""
    placed = identity.assign_position(R.extracted(spark, d), "instance")
    from fidelis.sources.readers import shard

    return _rounded_gate(run.calibration_gate(shard(placed, 0, run.GATE_SLICE), F.col("answer"), F.lit("cigarette")))


@query(f"WITH {R.EXTRACTED}, x AS (SELECT conv_id % 7 AS generator, count(*) AS n, count(answer) AS parsed, count(*) FILTER (WHERE answer = 'cigarette') AS agreed FROM (SELECT conv_id, CASE WHEN conv_id % 7 < 3 THEN CASE WHEN conv_id % 7 < 2 THEN 'cigarette' ELSE coalesce(answer, 'pen') END ELSE answer END AS answer FROM extracted) GROUP BY 1) SELECT generator, n, {_PASSED} FROM x")
def gates_by_generator(spark, d):
    """A gate for each generator; two give the expected answer throughout, one always an answer, the others as it comes."""
    g = F.col("conv_id") % 7
    answer = F.when(g < 2, F.lit("cigarette")).when(g < 3, F.coalesce("answer", F.lit("pen"))).otherwise(F.col("answer"))
    rows = R.extracted(spark, d).select(g.alias("generator"), answer.alias("answer"))
    return _rounded_gate(run.calibration_gate(rows, F.col("answer"), F.lit("cigarette"), ["generator"]))


@query("""WITH g AS (SELECT n_nationkey AS generator, 'g' || n_nationkey || CASE WHEN n_nationkey % 5 = 4 THEN '@old' ELSE '' END AS certified, n_nationkey % 3 <> 0 AS passed FROM nation WHERE n_nationkey < 20)
SELECT generator, refused, count(*) AS runs FROM (SELECT r.generator, CASE WHEN contains(identity, 'int8') THEN 'quantized identity' WHEN certified IS NULL THEN 'no gate artifact' WHEN NOT passed THEN 'failed gate' WHEN identity <> certified THEN 'other identity' END AS refused
 FROM (SELECT o_custkey % 25 AS generator, 'g' || (o_custkey % 25) || CASE WHEN o_orderkey % 6 = 0 THEN '-int8' ELSE '' END AS identity FROM orders) r LEFT JOIN g USING (generator)) GROUP BY ALL""")
def shard_guards(spark, d):
    """Runs of 25 generators, some quantized, against the gate artifacts of 20, of which some failed or certify an older identity."""
    n = F.col("n_nationkey")
    gates_made = R.table(spark, d, "nation").where(n < 20).select(n.alias("generator"), F.concat(F.lit("g"), n.cast("string"), F.when(n % 5 == 4, "@old").otherwise("")).alias("identity"), (n % 3 != 0).alias("passed"))
    g = F.col("o_custkey") % 25
    runs = R.table(spark, d, "orders").select(g.alias("generator"), F.concat(F.lit("g"), g.cast("string"), F.when(F.col("o_orderkey") % 6 == 0, "-int8").otherwise("")).alias("identity"))
    return run.refusals(runs, gates_made).groupBy("generator", "refused").agg(F.count("*").alias("runs"))


@query(f"WITH {R.READINGS} SELECT regime, count(*) AS n, count(*) FILTER (WHERE scores[instance % 3 + 1] >= list_max(scores)) AS with_ties, count(*) FILTER (WHERE list_position(scores, list_max(scores)) = instance % 3 + 1) AS first_only FROM readings GROUP BY regime")
def scorer_agreement(spark, d):
    base = F.col("instance") % 3
    return R.readings(spark, d).groupBy("regime").agg(F.count("*").alias("n"), F.count_if(stats.baseline_held(F.col("scores"), base)).alias("with_ties"), F.count_if(stats.argmax_first(F.col("scores")) == base).alias("first_only"))


@query(f"WITH {R.DRIFTS} SELECT instance, round(targeted, 9) AS drift FROM drifts")
def jaccard_drift(spark, d):
    return R.drifts(spark, d).select("instance", F.round("targeted", 9).alias("drift"))


@query("""SELECT a.vec_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS drift FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def embed_cosine_drift(spark, d):
    a = R.table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return a.join(b, "vec_id").select("vec_id", F.round(1 - stats.cosine(F.col("embedding"), F.col("next")), 6).alias("drift"))


@query("""WITH p AS (SELECT a.vec_id // 4 AS key, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON b.vec_id // 4 = a.vec_id // 4 + 1),
r AS (SELECT key, avg(m) AS r FROM (SELECT key, i, max(c) AS m FROM p GROUP BY ALL) GROUP BY key), q AS (SELECT key, avg(m) AS q FROM (SELECT key, j, max(c) AS m FROM p GROUP BY ALL) GROUP BY key)
SELECT key, round(1 - 2 * r * q / (r + q), 6) AS drift FROM r JOIN q USING (key)""")
def token_matching_drift(spark, d):
    """Four vectors in a row as a text's tokens, against the next four."""
    tokens = R.table(spark, d, "embeddings").groupBy(F.floor(F.col("vec_id") / 4).alias("key")).agg(F.collect_list("embedding").alias("before"))
    after = tokens.select((F.col("key") - 1).alias("key"), F.col("before").alias("after"))
    return tokens.join(after, "key").select("key", F.round(drift.token_matching_drift(F.col("before"), F.col("after")), 6).alias("drift"))


_LONG = "long AS (SELECT 'jaccard-content' AS instrument, targeted, control FROM drifts UNION ALL SELECT 'embed-cosine', round(targeted, 1), round(control, 1) FROM drifts UNION ALL SELECT 'nli-bidir', 1 - ((1 - targeted) + (1 - targeted) / 2) / 2, 1 - (1 - control) FROM drifts UNION ALL SELECT 'bertscore-baseline', control, targeted FROM drifts)"


@query(f"""WITH {R.DRIFTS}, {_LONG}, m AS (SELECT instrument, median(targeted - control) AS delta FROM long GROUP BY instrument), scored AS (SELECT instrument, targeted AS s, 1 AS t FROM long UNION ALL SELECT instrument, control, 0 FROM long),
c AS (SELECT instrument, s, count(*) FILTER (WHERE t = 1) AS pos, count(*) FILTER (WHERE t = 0) AS neg FROM scored GROUP BY ALL), w AS (SELECT *, pos * (coalesce(sum(neg) OVER (PARTITION BY instrument ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS wins FROM c),
a AS (SELECT instrument, sum(wins) / (sum(pos) * sum(neg))::DOUBLE AS auroc FROM w GROUP BY instrument), f AS (SELECT * FROM a JOIN m USING (instrument)),
best AS (SELECT instrument FROM f WHERE delta > 0 AND auroc >= (SELECT max(auroc) FROM f WHERE delta > 0) - 0.01 ORDER BY list_position(['jaccard-content', 'embed-cosine', 'nli-bidir', 'bertscore-baseline'], instrument) LIMIT 1)
SELECT f.instrument, round(auroc, 6) AS auroc, round(delta, 6) AS delta, coalesce(f.instrument = (SELECT instrument FROM best), false) AS chosen FROM f""")
def instrument_choice(spark, d):
    """Four stand-ins of instruments over the same pairs; the last has targeted and control drift swapped."""
    t, c = F.col("targeted"), F.col("control")
    made = {"jaccard-content": (t, c), "embed-cosine": (F.round(t, 1), F.round(c, 1)), "nli-bidir": (drift.entailment_drift(1 - t, (1 - t) / 2), drift.entailment_drift(1 - c, 1 - c)), "bertscore-baseline": (c, t)}
    rows = R.drifts(spark, d).select(F.explode(F.array(*(F.struct(F.lit(n).alias("instrument"), a.alias("targeted"), b.alias("control")) for n, (a, b) in made.items()))).alias("x")).select("x.*")
    return calibrate.choose_instrument(rows).withColumn("auroc", F.round("auroc", 6)).withColumn("delta", F.round("delta", 6))


_AUC = """SELECT {by} round(sum(wins) / nullif(sum(pos) * sum(neg), 0)::DOUBLE, 6) AS auroc, sum(pos)::BIGINT AS n_pos, sum(neg)::BIGINT AS n_neg FROM (SELECT *, pos * (coalesce(sum(neg) OVER ({part} ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg / 2) AS wins
 FROM (SELECT {by} s, count(*) FILTER (WHERE t = 1) AS pos, count(*) FILTER (WHERE t = 0) AS neg FROM scored GROUP BY {by} s)) {group}"""


@query(f"WITH {R.DRIFTS}, scored AS (SELECT targeted AS s, 1 AS t FROM drifts UNION ALL SELECT control, 0 FROM drifts) {_AUC.format(by='', part='', group='')}")
def drift_auroc(spark, d):
    rows = R.drifts(spark, d)
    scored = rows.select(F.explode(F.array(F.struct(F.col("targeted").alias("s"), F.lit(1).alias("t")), F.struct(F.col("control").alias("s"), F.lit(0).alias("t"))))).select("col.*")
    return evaluate.auroc(scored, "s", "t").withColumn("auroc", F.round("auroc", 6))


@query(f"""WITH {R.DRIFTS}, scored AS (SELECT targeted AS s, 1 AS t FROM drifts UNION ALL SELECT control, 0 FROM drifts), a AS ({_AUC.format(by='', part='', group='').replace('round(sum(wins) / nullif(sum(pos) * sum(neg), 0)::DOUBLE, 6)', 'sum(wins) / nullif(sum(pos) * sum(neg), 0)::DOUBLE')}),
v AS (SELECT *, sqrt(greatest(0.0::DOUBLE, auroc * (1 - auroc) + (n_pos - 1) * (auroc / (2 - auroc) - auroc * auroc) + (n_neg - 1) * (2 * auroc * auroc / (1 + auroc) - auroc * auroc)) / (n_pos::DOUBLE * n_neg)) AS se FROM a)
SELECT round(auroc, 6) AS auroc, round(greatest(0.0::DOUBLE, auroc - 1.96 * se), 6) AS low, round(least(1.0::DOUBLE, auroc + 1.96 * se), 6) AS high, n_pos, n_neg, auroc - 1.96 * se >= 0.71 AS viable FROM v""")
def drift_effect_gate(spark, d):
    """The gate by a closed form; drift_effect_resampled is the registered one."""
    rows = R.drifts(spark, d)
    scored = rows.select(F.explode(F.array(F.struct(F.col("targeted").alias("s"), F.lit(1).alias("t")), F.struct(F.col("control").alias("s"), F.lit(0).alias("t"))))).select("col.*")
    return evaluate.closed_form_gate(scored, "s", "t").select(*(F.round(c, 6).alias(c) for c in ("auroc", "low", "high")), "n_pos", "n_neg", "viable")


@query()
def drift_effect_resampled(spark, d):
    """10,000 resamples within each class, and the verdict of their lower bound."""
    scored = R.drifts(spark, d).select(F.explode(F.array(F.struct(F.col("targeted").alias("s"), F.lit(1).alias("t")), F.struct(F.col("control").alias("s"), F.lit(0).alias("t"))))).select("col.*")
    return evaluate.effect_gate(scored, "s", "t")


_TAIL = "list_sum(list_transform(range(m, n + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(k / n::DOUBLE) + (n - j) * ln(1 - k / n::DOUBLE))))"


@query(f"""WITH {R.DRIFTS}, x AS MATERIALIZED (SELECT targeted - control AS v, row_number() OVER (ORDER BY targeted - control) AS k, count(*) OVER () AS n FROM drifts),
mids AS (SELECT DISTINCT n, unnest([(n + 1) // 2, n // 2 + 1]) AS m FROM x), chances AS (SELECT x.v, x.k, x.n, m, CASE WHEN k = x.n THEN 1.0::DOUBLE ELSE {_TAIL.replace('(n ', '(x.n ').replace('(n -', '(x.n -').replace(', n ', ', x.n ').replace('/ n:', '/ x.n:')} END AS c FROM x, mids),
bounds AS (SELECT m, min(v) FILTER (WHERE c >= 0.025) AS low, min(v) FILTER (WHERE c >= 0.975) AS high FROM chances GROUP BY m)
SELECT (SELECT count(*) FROM drifts) AS n, (SELECT round(median(v), 6) FROM x) AS delta, round(avg(low), 6) AS low, round(avg(high), 6) AS high, avg(low) > 0 AS positive FROM bounds""")
def paired_delta_interval(spark, d):
    found = descriptives.paired_delta_interval(R.drifts(spark, d))
    return found.select("n", *(F.round(c, 6).alias(c) for c in ("delta", "low", "high")), "positive")


@query(f"WITH {R.DRIFTS} SELECT round(median(targeted - control), 6) AS delta, median(targeted - control) > 0 AS positive FROM drifts")
def paired_delta(spark, d):
    return descriptives.paired_delta(R.drifts(spark, d)).withColumn("delta", F.round("delta", 6))


@query(f"WITH {R.DRIFTS} SELECT instance % 2 = 0 AS flipped, count(*) AS n, round(avg(targeted), 6) AS mean_drift, round(median(targeted), 6) AS median_drift FROM drifts GROUP BY 1")
def drift_by_flip(spark, d):
    return descriptives.drift_by(R.drifts(spark, d), F.col("instance") % 2 == 0, "flipped")


@query(f"WITH {R.RESOLVED}, a AS (SELECT instance, res LIKE 'S%' AS on_res, drift >= 50 AS off_res FROM resolved), g AS (SELECT count(*)::DOUBLE AS n, count(*) FILTER (WHERE on_res <> off_res) AS flips FROM a) SELECT flips, n::BIGINT AS n, round((flips / n + 3.8416 / (2 * n) - 1.96 * sqrt(flips / n * (1 - flips / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low FROM g")
def ablation_flips(spark, d):
    on = R.resolved(spark, d).select("instance", F.col("res").startswith("S").alias("kept"))
    off = R.candidates(spark, d).select("instance", (F.col("drift") >= 50).alias("kept"))
    return evaluate.rule_flips(on, off, "instance", "kept").withColumn("low", F.round("low", 6))


# --- grids and images --------------------------------------------------------------------------------------


@query("SELECT p_partkey AS instance, cell, (cell // 8) * h // 8 AS top, (cell % 8) * w // 8 AS \"left\", (cell // 8 + 1) * h // 8 AS bottom, (cell % 8 + 1) * w // 8 AS \"right\" FROM (SELECT p_partkey, 64 + p_partkey % 200 AS h, 96 + (p_partkey * 7) % 150 AS w FROM part), range(64) AS t(cell)")
def cell_boxes(spark, d):
    cells = R.drops(spark, d)
    box = grid.cell_box(F.col("row"), F.col("col"), F.col("height"), F.col("width"))
    return cells.select("instance", "cell", box.alias("b")).select("instance", "cell", "b.*")


@query(f"""WITH {R.DROPS}, m AS (SELECT *, max("drop") OVER (PARTITION BY instance) AS max_drop FROM drops) SELECT instance, min("row" * height // 8) AS top, min(col * width // 8) AS "left",
 max(("row" + 1) * height // 8) AS bottom, max((col + 1) * width // 8) AS "right", max(max_drop) AS max_drop, count(*) AS n_cells FROM m WHERE max_drop >= 0.9::DOUBLE AND "drop" >= 0.5::DOUBLE * max_drop GROUP BY instance""")
def localize(spark, d):
    return grid.localize(R.drops(spark, d), "instance", 0.9)


@query(f"""WITH {R.BOXES}, s AS (SELECT *, bottom - top AS h, "right" - "left" AS w FROM boxes), placed AS (SELECT *, greatest(0, least("left", width - w)) AS ac, greatest(0, least(top, height - h)) AS ar FROM s),
cand AS (SELECT instance, top, "left", h, w, 0 AS o, 0 AS r, ac AS c FROM placed WHERE top >= h UNION ALL SELECT instance, top, "left", h, w, 1, height - h, ac FROM placed WHERE height - bottom >= h
 UNION ALL SELECT instance, top, "left", h, w, 2, ar, 0 FROM placed WHERE "left" >= w UNION ALL SELECT instance, top, "left", h, w, 3, ar, width - w FROM placed WHERE width - "right" >= w),
best AS (SELECT *, row_number() OVER (PARTITION BY instance ORDER BY (r - top) * (r - top) + (c - "left") * (c - "left") DESC, o) AS rn FROM cand)
SELECT b.instance, x.r AS c_top, x.c AS c_left, x.r + x.h AS c_bottom, x.c + x.w AS c_right FROM boxes b LEFT JOIN best x ON x.instance = b.instance AND x.rn = 1""")
def control_box(spark, d):
    c = grid.control_box(*(F.col(x) for x in ("top", "left", "bottom", "right", "height", "width")))
    return R.boxes(spark, d).withColumn("c", c).select("instance", *(F.col(f"c.{x}").alias(f"c_{x}") for x in ("top", "left", "bottom", "right")))


_TILES = f"""{R.BOXES}, tiles AS (SELECT b.*, r * 16 AS r0, c * 16 AS c0 FROM boxes b, range(0, 20) AS rr(r), range(0, 20) AS cc(c) WHERE r * 16 + 16 <= height AND c * 16 + 16 <= width
 AND (r * 16 + 16 <= top OR r * 16 >= bottom OR c * 16 + 16 <= "left" OR c * 16 >= "right")),
ranked AS (SELECT *, coalesce(sum(256) OVER (PARTITION BY instance ORDER BY r0, c0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM tiles),
kept AS (SELECT * FROM ranked WHERE before < (bottom - top) * ("right" - "left"))"""


@query(f"""WITH {_TILES}, sums AS (SELECT instance, count(*) AS n, max(r0 * 1000 + c0) AS last_tile FROM kept GROUP BY instance) SELECT b.instance, coalesce(n, 0) AS n_patches, coalesce(last_tile, -1) AS last_tile,
 round(coalesce(n, 0) * 256 / ((bottom - top) * ("right" - "left"))::DOUBLE, 3) AS coverage, coalesce(n, 0) * 256 >= 0.25 * (bottom - top) * ("right" - "left") AS applicable FROM boxes b LEFT JOIN sums USING (instance)""")
def control_patches(spark, d):
    out = grid.control_patches(R.boxes(spark, d))
    last = F.element_at(F.col("patches"), -1)
    area = (F.col("bottom") - F.col("top")) * (F.col("right") - F.col("left"))
    return out.select("instance", F.size("patches").cast("long").alias("n_patches"), F.when(F.size("patches") > 0, last["top"] * 1000 + last["left"]).otherwise(F.lit(-1)).alias("last_tile"), F.round(F.col("covered") / area, 3).alias("coverage"), "applicable")


@query("""WITH a AS (SELECT doc_id, list_transform(string_split(source || '-' || lang, ''), lambda c: ascii(c)) AS x, list_transform(string_split(source || '!' || doc_id || '?-' || lang, ''), lambda c: ascii(c)) AS y FROM documents)
SELECT doc_id, len(source)::BIGINT AS start, (len(source) + 2 + len(doc_id::VARCHAR))::BIGINT AS "end" FROM documents JOIN a USING (doc_id)""")
def reply_span(spark, d):
    codes = lambda c: F.transform(F.split(c, ""), F.ascii)
    docs = R.table(spark, d, "documents")
    before, after = F.concat_ws("-", "source", "lang"), F.concat("source", F.lit("!"), F.col("doc_id").cast("string"), F.lit("?-"), "lang")
    return docs.select("doc_id", grid.common_span(codes(before), codes(after)).alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, (len(source) + 1)::BIGINT AS start, (len(source) + 3)::BIGINT AS \"end\", 1::BIGINT AS n FROM documents")
def refine_span(spark, d):
    docs = R.table(spark, d, "documents").select("doc_id", F.split(F.concat("source", F.lit("# A.\n")), "").alias("ids"), F.length("source").cast("long").alias("at"))
    span = grid.refine_span(F.col("ids"), F.col("at"), F.col("at") + 5, F.lit("A."), lambda ids: F.regexp_replace(F.array_join(ids, ""), r"[ \n#]+", "#"))
    return docs.select("doc_id", span.alias("s")).select("doc_id", (F.col("s.start") - 1).alias("start"), (F.col("s.end") - 1).alias("end"), "s.n")


def _pixels(key: str, height: int, width: int):
    """Bytes of a small image that follow from the part's key: byte i is i * 7 + key * 13 modulo 256, so all images are cuts of one ramp, and 75 * 7 is 13 modulo 256."""
    n = height * width * 3
    return F.substring(F.lit(bytes(i * 7 % 256 for i in range(n + 255))), (F.pmod(F.col(key) % 256 * 75, F.lit(256)) + 1).cast("int"), F.lit(n))


def _dealt(df):
    """Rows of few bytes that much is made of, over all partitions: by their bytes they would be one task's."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "instance")


def _images(spark, d, height=32, width=48):
    """Tiny images from parts, with their derangement partners and boxes. Keys alone are ordered and joined; pixels follow from them at the end."""
    placed = identity.assign_position(R.table(spark, d, "part").select(F.col("p_partkey").alias("instance")), "instance")
    size = {"height": F.lit(height), "width": F.lit(width), "p_height": F.lit(height), "p_width": F.lit(width)}
    return _dealt(identity.derangement(placed, "instance")).withColumns(size | {"pixels": _pixels("instance", height, width), "p_pixels": _pixels("partner", height, width)})


def _sql_pixels(n: int, value: str) -> str:
    return f"sha256(unhex(array_to_string(list_transform(range({n}), lambda i: format('{{:02X}}', {value})), '')))"


_KEYED = "p AS (SELECT p_partkey AS k, coalesce(lead(p_partkey) OVER (ORDER BY p_partkey), first_value(p_partkey) OVER (ORDER BY p_partkey)) AS q FROM part)"


@query(f"""WITH {_KEYED} SELECT k AS instance, 'real' AS regime, {_sql_pixels(576, '(i * 7 + k * 13) % 256')} AS digest FROM p UNION ALL SELECT k, 'grey', {_sql_pixels(576, '128 + 0 * i')} FROM p
 UNION ALL SELECT k, 'wrong-image', {_sql_pixels(576, '(i * 7 + q * 13) % 256')} FROM p UNION ALL SELECT k, 'hflip', {_sql_pixels(576, '(((i // 48) * 48 + (15 - (i // 3) % 16) * 3 + i % 3) * 7 + k * 13) % 256')} FROM p""")
def image_fixed_regimes(spark, d):
    """The regimes that draw nothing at random, on images of 12 by 16 pixels."""
    return images.apply_regimes(_images(spark, d, 12, 16), ("real", "grey", "wrong-image", "hflip")).select("instance", "regime", F.sha2("pixels", 256).alias("digest"))


@query(f"""WITH {R.BOXES}, placed AS (SELECT instance // 8 AS image, * EXCLUDE (height, width) FROM boxes), moved AS (SELECT image, instance, top + instance % 13 * 9 - 40 AS top, "left" - instance % 7 * 11 + 20 AS "left", bottom + instance % 13 * 9 - 40 + (CASE WHEN instance % 41 = 0 THEN 3000 ELSE 0 END) AS bottom, "right" - instance % 7 * 11 + 20 AS "right" FROM placed)
SELECT a.image, a.instance AS instance_a, b.instance AS instance_b, (least(a.bottom, b.bottom) - greatest(a.top, b.top)) * (least(a."right", b."right") - greatest(a."left", b."left")) AS area FROM placed a JOIN moved b ON a.image = b.image AND a.top < b.bottom AND b.top < a.bottom AND a."left" < b."right" AND b."left" < a."right\"""")
def overlapping_boxes(spark, d):
    """Evidence boxes against boxes moved about, eight to an image, a few of them far larger."""
    placed = R.boxes(spark, d).withColumn("image", F.expr("instance div 8"))
    down, across = F.col("instance") % 13 * 9 - 40, 20 - F.col("instance") % 7 * 11
    moved = placed.withColumns({"top": F.col("top") + down, "left": F.col("left") + across, "bottom": F.col("bottom") + down + F.when(F.col("instance") % 41 == 0, 3000).otherwise(0), "right": F.col("right") + across})
    return overlap.overlap_join(placed, moved, "instance", ["image"])


@query(f"SELECT p_partkey AS instance, cell, {_sql_pixels(384, 'CASE WHEN i // 24 // 2 = cell // 8 AND (i // 3) % 8 = cell % 8 THEN 0 ELSE (i * 7 + p_partkey * 13) % 256 END')} AS digest FROM part, range(64) AS t(cell)")
def image_sweep(spark, d):
    """Each image, 16 by 8 pixels, with one cell of the grid blackened at a time."""
    small = _dealt(R.table(spark, d, "part").select(F.col("p_partkey").alias("instance"))).withColumns({"height": F.lit(16), "width": F.lit(8), "pixels": _pixels("instance", 16, 8)})
    return images.sweep_cells(small).select("instance", "cell", F.sha2("pixels", 256).alias("digest"))


@query()
def image_regimes(spark, d):
    return images.apply_regimes(_images(spark, d)).select("instance", "regime", F.sha2("pixels", 256).alias("digest"))


@query()
def image_edits(spark, d):
    box = _images(spark, d).select("*", F.lit(4).alias("top"), (F.col("instance") % 20).alias("left"), F.lit(20).alias("bottom"), (F.col("instance") % 20 + 17).alias("right"))
    placed = grid.control_patches(box).withColumn("box", F.struct("top", "left", "bottom", "right"))
    return images.apply_edits(placed).select("instance", F.sha2("targeted", 256).alias("targeted"), F.sha2("control", 256).alias("control"))


@query("SELECT doc_id, 'A. ' || lang AS reply, n_chars::DOUBLE AS score FROM documents")
def model_call(spark, d):
    def model():
        return lambda frame: frame.assign(reply="A. " + frame["lang"], score=frame["n_chars"].astype(float))[["doc_id", "reply", "score"]]

    return images.call_model(R.table(spark, d, "documents").select("doc_id", "lang", "n_chars"), model, "doc_id long, reply string, score double")


_TOKEN = "(instance * 31 + option * 17 + {p} * 7) % 64"
_LOGITS = f"""steps AS (SELECT vec_id // 16 AS instance, vec_id // 4 % 4 AS option, vec_id % 4 AS pos, list_transform(embedding, lambda x: x::DOUBLE * 40) AS x FROM embeddings),
lp AS (SELECT instance, option, pos, x[{_TOKEN.format(p='(pos + 1)')} + 1] - list_max(x) - ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) AS lp FROM steps),
scores AS (SELECT instance, option, count(*) AS n_tokens, sum(lp) AS score FROM lp WHERE pos >= instance % 2 GROUP BY ALL)"""


def _reply_scores(spark, d):
    """Vectors as logits of up to four positions, four options to an instance; tokens follow from the keys, prompts are of one or two.

    A sequence has the positions that have a vector, numbered anew, each with the token that it predicts; one without a reply is none.
    Vectors that are null, short or hold nulls add what is known of them, as in the SQL, and do not stop the others.
    """
    v, own = F.col("vec_id"), Window.partitionBy("instance", "option")
    logits = R.table(spark, d, "embeddings").select(F.expr("vec_id div 16").alias("instance"), (F.expr("vec_id div 4") % 4).alias("option"), (v % 4).alias("at"), F.transform("embedding", lambda x: x.cast("double") * 40).alias("logits"))
    logits = logits.where("at is not null").withColumn("pos", F.row_number().over(own.orderBy("at")) - 1)
    token = lambda p: (F.col("instance") * 31 + F.col("option") * 17 + p * 7) % 64
    sequences = logits.groupBy("instance", "option").agg(F.sort_array(F.collect_list("at")).alias("at")).withColumn("prompt_len", 1 + F.size(F.filter("at", lambda p: p < F.col("instance") % 2)))
    sequences = sequences.withColumn("ids", F.concat(F.array(token(F.lit(0))), F.transform("at", lambda p: token(p + 1))))
    sequences = sequences.withColumn("reply_ids", F.slice("ids", F.col("prompt_len") + 1, F.size("ids"))).where(F.size("reply_ids") > 0)
    return scoring.reply_scores(sequences, logits, ["instance", "option"], known_only=True)


@query(f"WITH {_LOGITS} SELECT instance, option, n_tokens, round(score, 6) AS score FROM scores")
def reply_scores(spark, d):
    return _reply_scores(spark, d).withColumn("score", F.round("score", 6))


@query(f"WITH {_LOGITS}, r AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM scores WINDOW w AS (PARTITION BY instance ORDER BY score DESC, option)) SELECT instance, option AS choice, round(score - second, 6) AS margin FROM r WHERE k = 1")
def reply_choices(spark, d):
    return scoring.choices(_reply_scores(spark, d), ["instance"], "option").withColumn("margin", F.round("margin", 6))


# --- assembly and views ------------------------------------------------------------------------------------


@query(f"WITH {R.PREDICTED} SELECT instance, scene, split FROM predicted")
def split_assign(spark, d):
    return R.predicted(spark, d).select("instance", "scene", "split")


@query(f"WITH {R.PREDICTED}, q AS (SELECT split, CASE WHEN count(*) < (SELECT count(DISTINCT label) FROM predicted) THEN 0 ELSE min(n) END AS quota FROM (SELECT split, label, count(*) AS n FROM predicted WHERE split IN ('train', 'validation') GROUP BY ALL) GROUP BY split), r AS (SELECT *, row_number() OVER (PARTITION BY split, label ORDER BY md5(instance::VARCHAR), instance) AS rn FROM predicted) SELECT instance, split, label FROM r LEFT JOIN q USING (split) WHERE quota IS NULL OR rn <= quota")
def balance_split(spark, d):
    return assemble.balance(R.predicted(spark, d)).select("instance", "split", "label")


@query(f"WITH {R.PREDICTED} SELECT split, count(*) AS n FROM predicted WHERE instance NOT IN (SELECT item_id * 3 FROM benchmark) GROUP BY split")
def quarantine(spark, d):
    touched = R.table(spark, d, "benchmark").select((F.col("item_id") * 3).alias("instance"))
    return assemble.quarantine(R.predicted(spark, d), touched, "instance").groupBy("split").agg(F.count("*").alias("n"))


@query(f"WITH {R.PREDICTED}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, qtype, truth ORDER BY md5(instance::VARCHAR), instance) AS rn FROM predicted) SELECT a.dataset, a.qtype, a.rn AS rank, a.instance AS negative, b.instance AS positive FROM r a JOIN r b USING (dataset, qtype, rn) WHERE a.truth = 0 AND b.truth = 1")
def hard_core(spark, d):
    return assemble.matched_pairs(R.predicted(spark, d), ["dataset", "qtype"], "truth", "instance")


@query(f"WITH {R.PREDICTED}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, qtype, truth ORDER BY md5('control' || instance), instance) AS rn FROM predicted), m AS (SELECT a.dataset, a.qtype, a.rn AS rank, a.instance AS negative, b.instance AS positive, max(a.rn) OVER (PARTITION BY a.dataset, a.qtype) AS most FROM r a JOIN r b USING (dataset, qtype, rn) WHERE a.truth = 0 AND b.truth = 1) SELECT dataset, qtype, rank, negative, positive FROM m WHERE rank <= ceil(most * 0.5::DOUBLE)")
def control_sample(spark, d):
    """Half of the pairs of a stratum, paired at random, beside the hard core."""
    return assemble.control_sample(R.predicted(spark, d), ["dataset", "qtype"], "truth", "instance", 0.5)


#: Every round works on what the rounds before left; the last one that finds a pair is the last that is kept.
_NEAREST = """m AS (SELECT 0 AS r, dataset, qtype, instance, truth, score, NULL::BIGINT AS partner, NULL::DOUBLE AS distance FROM predicted WHERE score IS NOT NULL AND truth IN (0, 1)
 UNION ALL SELECT r + 1, dataset, qtype, instance, truth, score, partner, distance FROM (SELECT *, count(partner) OVER () AS found FROM (SELECT r, dataset, qtype, instance, truth, score,
  CASE WHEN opens AND after - score <= 40 THEN next WHEN NOT opens AND score - before <= 40 THEN last END AS partner, CASE WHEN opens AND after - score <= 40 THEN after - score WHEN NOT opens AND score - before <= 40 THEN score - before END AS distance
 FROM (SELECT *, lead(instance) OVER w AS next, lead(score) OVER w AS after, lag(instance) OVER w AS last, lag(score) OVER w AS before FROM (SELECT *, (level >= 0) = (truth = 1) AS opens
 FROM (SELECT *, least(height, height - step) AS level FROM (SELECT *, sum(step) OVER (PARTITION BY dataset, qtype, chain ORDER BY score, instance ROWS UNBOUNDED PRECEDING) AS height
 FROM (SELECT *, 2 * truth - 1 AS step, sum(coalesce((score - prev > 40)::INT, 1)) OVER (PARTITION BY dataset, qtype ORDER BY score, instance ROWS UNBOUNDED PRECEDING) AS chain
 FROM (SELECT *, lag(score) OVER (PARTITION BY dataset, qtype ORDER BY score, instance) AS prev FROM m WHERE partner IS NULL)))))
 WINDOW w AS (PARTITION BY dataset, qtype, chain, level ORDER BY score, instance)))) WHERE found > 0)"""
_MATCHED = (["dataset", "qtype"], "truth", "instance", "score", 40.0)


@query(f"WITH RECURSIVE {R.PREDICTED}, {_NEAREST} SELECT dataset, qtype, instance AS negative, partner AS positive, distance FROM m WHERE truth = 0 AND partner IS NOT NULL")
def plausibility_pairs(spark, d):
    """Negatives and positives of near scores within dataset and question type."""
    return matching.nearest_pairs(R.predicted(spark, d), *_MATCHED)


@query(f"""WITH RECURSIVE {R.PREDICTED}, {_NEAREST}, kept AS (SELECT DISTINCT instance FROM m WHERE partner IS NOT NULL), c AS (SELECT p.* FROM predicted p JOIN kept USING (instance))
SELECT count(*) AS n, count(*) FILTER (WHERE truth = 1) AS positives, round(avg((pred = truth)::INT), 6) AS accuracy, '{{"caliper": 40.0, "key": "instance", "label": "truth", "rule": "nearest-score, without replacement", "score": "score", "stratum": ["dataset", "qtype"]}}' AS selector FROM c""")
def plausibility_control(spark, d):
    """A predictor's accuracy on the matched control subset, beside what a manifest records of its selection."""
    entries = R.predicted(spark, d)
    held = matching.matched_membership(entries, matching.nearest_pairs(entries, *_MATCHED), _MATCHED[0], "instance")
    return held.agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("positives"), F.round(F.avg((F.col("pred") == F.col("truth")).cast("int")), 6).alias("accuracy")).withColumn("selector", matching.selector(*_MATCHED))


_LEAVES = "{name} AS (SELECT sha256(instance::VARCHAR) AS path, sha256('leaf:' || to_json({{'instance': instance, 'split': split, 'label': label, 'reason': reason}})::VARCHAR) AS leaf, instance::VARCHAR AS key FROM {rows})"
_NODES = """l2 AS (SELECT substr(path, 1, 2) AS prefix, sha256('node:' || string_agg(path || leaf, '' ORDER BY path)) AS digest, count(*) AS n FROM leaves GROUP BY 1),
l1 AS (SELECT substr(prefix, 1, 1) AS up, sha256('node:' || string_agg(prefix || digest, '' ORDER BY prefix)) AS digest, sum(n) AS n FROM l2 GROUP BY 1)"""


def _release(spark, d):
    return R.predicted(spark, d).select("instance", "split", "label", "reason")


@query(f"WITH {R.PREDICTED}, {_LEAVES.format(name='leaves', rows='predicted')}, {_NODES} SELECT 2::BIGINT AS level, prefix, digest, n FROM l2 UNION ALL SELECT 1, up, digest, n::BIGINT FROM l1 UNION ALL SELECT 0, '', sha256('node:' || string_agg(up || digest, '' ORDER BY up)), sum(n)::BIGINT FROM l1")
def merkle_nodes(spark, d):
    """The tree of a release, two levels deep."""
    return merkle.tree(merkle.leaves(_release(spark, d), "instance", ["split", "label", "reason"]), 2)


@query(f"WITH {R.PREDICTED}, later AS (SELECT instance, split, CASE WHEN instance % 31 = 0 THEN 'withdrawn' ELSE label END AS label, reason FROM predicted WHERE instance % 37 > 0 UNION ALL SELECT -instance - 1, split, label, reason FROM predicted WHERE instance % 41 = 0), {_LEAVES.format(name='x', rows='predicted')}, {_LEAVES.format(name='y', rows='later')} SELECT coalesce(x.key, y.key) AS key, CASE WHEN x.leaf IS NULL THEN 'added' WHEN y.leaf IS NULL THEN 'removed' ELSE 'changed' END AS kind FROM x FULL JOIN y USING (path) WHERE x.leaf IS DISTINCT FROM y.leaf")
def merkle_difference(spark, d):
    """A release against a later one with entries added, withdrawn and removed."""
    first, i = _release(spark, d), F.col("instance")
    kept = first.where(i % 37 > 0).withColumn("label", F.when(i % 31 == 0, "withdrawn").otherwise(F.col("label")))
    later = kept.unionByName(first.where(i % 41 == 0).withColumn("instance", -i - 1))
    sides = [merkle.leaves(x, "instance", ["split", "label", "reason"]) for x in (first, later)]
    return merkle.difference(merkle.tree(sides[0], 2), sides[0], merkle.tree(sides[1], 2), sides[1])


@query(f"WITH {R.PREDICTED}, s AS (SELECT DISTINCT split, scene FROM predicted) SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared FROM s a JOIN s b USING (scene) WHERE a.split < b.split GROUP BY ALL")
def split_disjointness(spark, d):
    return assemble.disjointness(R.predicted(spark, d), "scene")


_DIGEST = "count(*) || ':' || bit_xor(('0x' || substr(h, 1, 15))::BIGINT) || ':' || sum(('0x' || substr(h, 16, 8))::BIGINT)"
_HASHED = "hashed AS (SELECT *, sha256(concat_ws('|', instance::VARCHAR, label, coalesce(reason, '~'))) AS h FROM predicted)"


@query(f"WITH {R.PREDICTED}, {_HASHED} SELECT split, label, count(*) AS n, count(DISTINCT generator) AS generators, count(DISTINCT scene) AS scenes, {_DIGEST} AS digest FROM hashed GROUP BY ROLLUP (split, label)")
def manifest_counts(spark, d):
    return assemble.manifest(R.predicted(spark, d), ["instance", "label", "reason"])


@query(f"WITH {R.PREDICTED}, {_HASHED} SELECT split, {_DIGEST} AS digest, count(*) AS n FROM hashed GROUP BY split")
def entry_digests(spark, d):
    return assurance.entry_digests(R.predicted(spark, d), ["split"], ["instance", "label", "reason"])


@query(f"WITH {R.PREDICTED} SELECT count(*) AS entries FROM predicted")
def corpus_assembly(spark, d):
    return assemble.assemble(R.predicted(spark, d), ("instance", "label", "split", "scene", "generator")).agg(F.count("*").alias("entries"))


def _released(spark, d):
    """Entries with the whole tuple that predictors see, and what only auditors do."""
    rows, i = R.predicted(spark, d).withColumnsRenamed({"instance": "instance_id", "reason": "reason_code"}), F.col("instance_id").cast("string")
    return rows.withColumns({
        "image": F.concat(F.lit("img/"), "scene"), "question": F.concat(F.lit("Q"), i), "options": F.lit("yes|no"), "chosen_answer": F.when(F.col("pred") == 1, "yes").otherwise("no"), "rationale": F.concat(F.lit("because of "), i),
        "state": F.when(F.col("label") == "faithful", "S3").otherwise("S1"), "generator_id": F.col("generator"), "margins": F.col("score"), "sealed_provenance": F.concat(F.lit("p"), i),
    })


@query(f"WITH {R.PREDICTED} SELECT instance AS instance_id, split, 'img/' || scene AS image, 'Q' || instance AS question, 'yes|no' AS options, CASE WHEN pred = 1 THEN 'yes' ELSE 'no' END AS chosen_answer, 'because of ' || instance AS rationale FROM predicted")
def predictor_view(spark, d):
    return views.predictor_view(_released(spark, d))


@query(f"WITH {R.PREDICTED} SELECT instance AS instance_id, label, reason AS reason_code, split FROM predicted")
def hidden_view(spark, d):
    return views.hidden_view(_released(spark, d))


@query(f"WITH {R.PREDICTED} SELECT sha256('salt|' || instance) AS audit_id, CASE WHEN label = 'faithful' THEN 'S3' ELSE 'S1' END AS state, generator AS generator_id, score AS margins, 'p' || instance AS sealed_provenance FROM predicted")
def audit_view(spark, d):
    return views.audit_view(_released(spark, d), "salt")


def _views(spark, d):
    entries = _released(spark, d)
    predictor = views.predictor_view(entries).withColumn("extra", F.when(F.col("instance_id") % 17 == 0, F.create_map(F.lit("margins"), F.lit("1"))).otherwise(F.create_map(F.lit("note"), F.lit("1"))))
    labels = entries.where("split = 'train' or instance_id % 13 = 0").select("instance_id", "label").unionAll(spark.createDataFrame([(-1, "faithful")], "instance_id long, label string"))
    audit = entries.select(F.when(F.col("instance_id") % 19 == 0, F.col("instance_id").cast("string")).otherwise(views.severed(F.col("instance_id"), "salt")).alias("audit_id"))
    return predictor, labels, audit


def _verdict(where: str, name: str, key: str = "instance::VARCHAR") -> str:
    return f"SELECT '{name}' AS \"check\", count(*) = 0 AS passed, count(*) AS violations, min({key}) AS first_violation FROM {where}"


_LABELS = "labelled AS (SELECT instance, split FROM predicted WHERE split = 'train' OR instance % 13 = 0 UNION ALL SELECT -1, NULL)"
_CHECKS = [
    _verdict("predicted WHERE instance % 17 = 0", "predictor_view_exclusions"),
    _verdict("labelled WHERE split IS DISTINCT FROM 'train'", "train_label_join_restriction"),
    _verdict("labelled WHERE coalesce(split, '') NOT IN ('train', 'validation')", "split_isolation"),
    _verdict("predicted WHERE instance % 19 = 0", "audit_non_joinability"),
]


@query(f"WITH {R.PREDICTED} {_CHECKS[0]}")
def boundary_exclusions(spark, d):
    return views.check_exclusions(_views(spark, d)[0])


@query(f"WITH {R.PREDICTED}, {_LABELS} {_CHECKS[1]}")
def boundary_label_join(spark, d):
    predictor, labels, _ = _views(spark, d)
    return views.check_label_join(labels, predictor)


@query(f"WITH {R.PREDICTED}, {_LABELS} {_CHECKS[2]}")
def boundary_split_isolation(spark, d):
    predictor, labels, _ = _views(spark, d)
    return views.check_split_isolation(labels, predictor)


@query(f"WITH {R.PREDICTED} {_CHECKS[3]}")
def boundary_audit(spark, d):
    predictor, _, audit = _views(spark, d)
    return views.check_audit(audit, predictor.withColumn("instance_id", F.col("instance_id").cast("string")))


def _four_views(spark, d):
    predictor, labels, audit = _views(spark, d)
    text_ids = predictor.withColumn("instance_id", F.col("instance_id").cast("string"))
    return {"predictor_view": text_ids, "train_labels": labels.withColumn("instance_id", F.col("instance_id").cast("string")), "hidden_view": views.hidden_view(_released(spark, d)), "audit_view": audit}


@query(f"WITH {R.PREDICTED}, {_LABELS} " + " UNION ALL ".join(_CHECKS))
def boundary_report(spark, d):
    return views.boundary_report(_four_views(spark, d))


# One attested for this version, by two people; one for another version only; one without a name.
_ATTESTED = [("N12.2", "rey", "v1"), ("N12.2", "ann", "v1"), ("N12.5", "ann", "v0"), ("N13.2", " ", "v1"), ("N99", "ann", "v1")]


def _whole_report(spark, d):
    return views.whole_report(_four_views(spark, d), spark.createDataFrame(_ATTESTED, "obligation string, attested_by string, corpus_version string"), "v1")


_WHOLE = f"""SELECT 'verified' AS kind, *, NULL::VARCHAR AS attested_by FROM ({' UNION ALL '.join(_CHECKS)}) UNION ALL
 SELECT 'attested', code, code = 'N12.2', NULL, NULL, CASE WHEN code = 'N12.2' THEN 'ann' END FROM (VALUES ('N12.2'), ('N12.5'), ('N13.2')) AS o(code)"""


@query(f"WITH {R.PREDICTED}, {_LABELS} {_WHOLE}")
def boundary_obligations(spark, d):
    return _whole_report(spark, d)


@query("""SELECT 'ragged_exclusions' AS "check", count(*) = 0 AS passed, count(*) AS violations, min(event_id::VARCHAR) AS first_violation FROM (SELECT event_id, json_merge_patch(props, CASE event_type WHEN 'error' THEN '{"margins": 1}' ELSE '{"note": 1}' END) AS j FROM events)
 WHERE list_contains(json_keys(j), 'margins')""")
def ragged_props(spark, d):
    """The props of every event, those of errors with a key that must not be seen."""
    more = F.when(F.col("event_type") == "error", F.lit(', "margins": 1}')).otherwise(F.lit(', "note": 1}'))
    rows = R.table(spark, d, "events").select("event_id", F.concat(F.regexp_replace("props", r"\}\s*$", ""), more).alias("props"))
    return views.check_ragged(rows, "props", "event_id")




_KEYS = "CASE WHEN json_valid(props) AND json_type(props) = 'OBJECT' THEN list_sort(list_distinct(json_keys(props))) END"
_NAMED = ", ".join(f"'{name}'" for name in views.FORBIDDEN)


@query(f"SELECT event_id, array_to_string(keys, ',') AS keys, array_to_string(list_filter(keys, lambda k: k IN ({_NAMED})), ',') AS forbidden FROM (SELECT event_id, {_KEYS} AS keys FROM events)")
def ragged_view_rows(spark, d):
    rows = views.ragged_keys(R.table(spark, d, "events").select("event_id", "props"), "props")
    return rows.select("event_id", F.array_join("keys", ",").alias("keys"), F.array_join("forbidden", ",").alias("forbidden"))


# --- evaluation --------------------------------------------------------------------------------------------

_F1 = "coalesce(2.0::DOUBLE * {0} / nullif(2.0::DOUBLE * {0} + {1} + {2}, 0), 0.0::DOUBLE)"


def _macro(t: str, p: str) -> str:
    n = lambda a, b: f"count(*) FILTER (WHERE {t} = {a} AND {p} = {b})"
    return f"(({_F1.format(n(1, 1), n(0, 1), n(1, 0))}) + ({_F1.format(n(0, 0), n(1, 0), n(0, 1))})) / 2"


@query(f"WITH {R.PREDICTED} SELECT split, round({_macro('truth', 'pred')}, 6) AS macro_f1, count(*) AS n FROM predicted GROUP BY split")
def macro_f1_by_split(spark, d):
    return R.predicted(spark, d).groupBy("split").agg(F.round(evaluate.macro_f1(F.col("truth"), F.col("pred")), 6).alias("macro_f1"), F.count("*").alias("n"))


@query(f"WITH {R.PREDICTED}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, qtype, truth ORDER BY md5(instance::VARCHAR), instance) AS rn FROM predicted), m AS (SELECT a.instance AS x, b.instance AS y FROM r a JOIN r b USING (dataset, qtype, rn) WHERE a.truth = 0 AND b.truth = 1), scored AS (SELECT score AS s, truth AS t FROM predicted WHERE instance IN (SELECT x FROM m UNION ALL SELECT y FROM m)) {_AUC.format(by='', part='', group='')}")
def auroc_hard_core(spark, d):
    entries = R.predicted(spark, d)
    core = assemble.matched_pairs(entries, ["dataset", "qtype"], "truth", "instance").select(F.explode(F.array("negative", "positive")).alias("instance"))
    return evaluate.auroc(entries.join(core, "instance", "left_semi"), "score", "truth").withColumn("auroc", F.round("auroc", 6))


@query(f"WITH {R.PREDICTED}, scored AS (SELECT split, score AS s, truth AS t FROM predicted) {_AUC.format(by='split,', part='PARTITION BY split', group='GROUP BY split')}")
def auroc_by_split(spark, d):
    return evaluate.auroc(R.predicted(spark, d), "score", "truth", ["split"]).withColumn("auroc", F.round("auroc", 6))


_SWEEP = f"""swept AS (SELECT score AS threshold, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () - sum(pos) OVER w AS fn, sum(neg) OVER () - sum(neg) OVER w AS tn
 FROM (SELECT score, count(*) FILTER (WHERE truth = 1) AS pos, count(*) FILTER (WHERE truth = 0) AS neg FROM predicted WHERE split = 'validation' GROUP BY score) WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pointed AS (SELECT threshold, round(({_F1.format('tp', 'fp', 'fn')} + {_F1.format('tn', 'fn', 'fp')}) / 2, 12) AS macro_f1 FROM swept),
frozen AS (SELECT threshold, macro_f1 FROM pointed ORDER BY macro_f1 DESC, threshold DESC LIMIT 1)"""


@query(f"WITH {R.PREDICTED}, {_SWEEP} SELECT threshold, round(macro_f1, 6) AS macro_f1, 0::BIGINT AS unscored FROM frozen")
def operating_point(spark, d):
    return evaluate.operating_point(R.predicted(spark, d).where("split = 'validation'"), "score", "truth").withColumn("macro_f1", F.round("macro_f1", 6))


@query(f"WITH {R.PREDICTED.replace('predicted AS', 'whole AS')}, predicted AS (SELECT * EXCLUDE (score), CASE WHEN instance % 5 > 0 THEN score END AS score FROM whole), {_SWEEP.replace('GROUP BY score)', 'AND score IS NOT NULL GROUP BY score)')} SELECT threshold, round(macro_f1, 6) AS macro_f1, (SELECT count(*) FROM predicted WHERE split = 'validation' AND score IS NULL) AS unscored FROM frozen")
def operating_point_unscored(spark, d):
    """Every fifth entry has no score."""
    rows = R.predicted(spark, d).where("split = 'validation'").withColumn("score", F.when(F.col("instance") % 5 > 0, F.col("score")))
    return evaluate.operating_point(rows, "score", "truth").withColumn("macro_f1", F.round("macro_f1", 6))


@query(f"WITH {R.PREDICTED}, {_SWEEP}, scored AS (SELECT p.*, (score >= threshold)::BIGINT AS chosen FROM predicted p, frozen) SELECT split, round({_macro('truth', 'chosen')}, 6) AS macro_f1 FROM scored GROUP BY split")
def operating_point_applied(spark, d):
    entries = R.predicted(spark, d)
    frozen = evaluate.operating_point(entries.where("split = 'validation'"), "score", "truth").select("threshold")
    chosen = entries.crossJoin(F.broadcast(frozen)).withColumn("chosen", (F.col("score") >= F.col("threshold")).cast("long"))
    return chosen.groupBy("split").agg(F.round(evaluate.macro_f1(F.col("truth"), F.col("chosen")), 6).alias("macro_f1"))


_PRIOR = "prior AS (SELECT (avg(truth) >= 0.5)::BIGINT AS majority FROM predicted WHERE split = 'train')"


@query(f"WITH {R.PREDICTED}, {_PRIOR}, based AS (SELECT p.*, majority, ({R.sql_uniform("'random'", 'instance')} < 0.5::DOUBLE)::BIGINT AS guess FROM predicted p, prior) SELECT split, round({_macro('truth', 'majority')}, 6) AS majority_f1, round({_macro('truth', 'guess')}, 6) AS random_f1 FROM based GROUP BY split")
def random_and_majority_baselines(spark, d):
    based = evaluate.baselines(R.predicted(spark, d), "truth", "instance")
    return based.groupBy("split").agg(F.round(evaluate.macro_f1(F.col("truth"), F.col("majority")), 6).alias("majority_f1"), F.round(evaluate.macro_f1(F.col("truth"), F.col("random")), 6).alias("random_f1"))


@query(f"""WITH {R.PREDICTED}, {_SWEEP.replace("split = 'validation'", "split = 'train'").replace('score', 'toxic_score')}, based AS (SELECT p.*, coalesce((qtype IN ('q0', 'q1'))::BIGINT, 0) AS heuristic, coalesce((toxic_score >= threshold)::BIGINT, 0) AS text_only FROM (SELECT *, (instance % 97)::DOUBLE AS toxic_score FROM predicted) p, (SELECT max(threshold) AS threshold FROM frozen) AS f)
SELECT split, round({_macro('truth', 'heuristic')}, 6) AS heuristic_f1, round({_macro('truth', 'text_only')}, 6) AS text_only_f1 FROM based GROUP BY split""".replace("FROM predicted WHERE split = 'train' GROUP BY", "FROM (SELECT *, (instance % 97)::DOUBLE AS toxic_score FROM predicted) WHERE split = 'train' GROUP BY"))
def heuristic_and_text_baselines(spark, d):
    """A rule over the question type, and a threshold on a text score that train's labels have set."""
    entries = R.predicted(spark, d)
    based = evaluate.baselines(entries, "truth", "instance", (F.col("instance") % 97).cast("double"), F.col("qtype").isin("q0", "q1"))
    return based.groupBy("split").agg(F.round(evaluate.macro_f1(F.col("truth"), F.col("heuristic")), 6).alias("heuristic_f1"), F.round(evaluate.macro_f1(F.col("truth"), F.col("text_only")), 6).alias("text_only_f1"))


@query(f"WITH {R.PREDICTED}, {_PRIOR} SELECT split, round({_macro('truth', 'pred')} - {_macro('truth', 'majority')}, 6) AS floor_gap, round(1 - {_macro('truth', 'pred')}, 6) AS oracle_gap FROM predicted, prior GROUP BY split")
def floor_gap(spark, d):
    entries = R.predicted(spark, d)
    rows = entries.crossJoin(F.broadcast(evaluate.majority(entries, "truth")))
    return evaluate.floor_gaps(rows, "truth", "pred", "majority").select("split", F.round("floor_gap", 6).alias("floor_gap"), F.round("oracle_gap", 6).alias("oracle_gap"))


@query(f"WITH {R.PREDICTED}, m AS (SELECT split, {_macro('truth', 'pred')} AS f FROM predicted GROUP BY split) SELECT o.split, round(i.f - o.f, 6) AS transfer_gap FROM m o, m i WHERE i.split = 'iid-test' AND o.split LIKE 'ood-%'")
def transfer_gap(spark, d):
    return evaluate.transfer_gaps(R.predicted(spark, d), "truth", "pred").withColumn("transfer_gap", F.round("transfer_gap", 6))


@query(f"WITH {R.PREDICTED}, u AS (SELECT (reason = 'D1')::BIGINT AS t, pred AS p FROM predicted WHERE label = 'unfaithful') SELECT round({_macro('t', 'p')}, 6) AS reason_f1, count(*) AS n FROM u")
def reason_code_f1(spark, d):
    return evaluate.reason_f1(R.predicted(spark, d), "reason", "pred").withColumn("reason_f1", F.round("reason_f1", 6))


@query("""WITH o AS (SELECT o_custkey % 500 AS question, o_orderkey % 4 AS gen, max(o_totalprice) > 300000 AS v FROM orders GROUP BY 1, 2), p AS (SELECT a.gen AS gen_a, b.gen AS gen_b, a.v AS x, b.v AS y FROM o a JOIN o b ON a.question = b.question AND a.gen < b.gen),
s AS (SELECT gen_a, gen_b, count(*) AS n, avg((x = y)::INT) AS po, avg(x::INT) * avg(y::INT) + (1 - avg(x::INT)) * (1 - avg(y::INT)) AS pe FROM p GROUP BY ALL), h AS (SELECT *, 1.96 * sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))) AS half FROM s)
SELECT gen_a, gen_b, n, round((po - pe) / (1 - pe), 6) AS kappa, round((po - pe) / (1 - pe) - half, 6) AS low, round((po - pe) / (1 - pe) + half, 6) AS high FROM h""")
def kappa_pairs(spark, d):
    votes = R.table(spark, d, "orders").groupBy((F.col("o_custkey") % 500).alias("question"), (F.col("o_orderkey") % 4).alias("gen")).agg((F.max("o_totalprice") > 300000).alias("v"))
    found = evaluate.kappa_pairs(votes, "question", "gen", "v")
    return found.select("gen_a", "gen_b", "n", *(F.round(c, 6).alias(c) for c in ("kappa", "low", "high")))


@query(f"""WITH {R.ENTRIES}, s AS (SELECT count(*)::DOUBLE AS n, avg((truth = pred)::INT) AS po, avg(truth) * avg(pred) + (1 - avg(truth)) * (1 - avg(pred)) AS pe FROM entries)
SELECT round((po - pe) / (1 - pe), 6) AS kappa, round((po - pe) / (1 - pe) - 1.96 * sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))), 6) AS low, round((po - pe) / (1 - pe) + 1.96 * sqrt(po * (1 - po) / (n * (1 - pe) * (1 - pe))), 6) AS high, n::BIGINT AS n FROM s""")
def kappa(spark, d):
    return evaluate.kappa(R.entries(spark, d), "truth", "pred").select(*(F.round(c, 6).alias(c) for c in ("kappa", "low", "high")), "n")


_U = "((('0x' || substr(md5(concat_ws('|', replicate // 4, dataset, block)), 1, 15))::BIGINT >> (15 * (replicate % 4))::INT) & 32767) / 32768.0::DOUBLE"


@query(f"""WITH {R.ENTRIES}, dealt AS (SELECT floor({R.sql_uniform("'block'", "instance")} * {evaluate.BLOCKS})::BIGINT AS block, dataset, (truth = pred)::INT::DOUBLE AS v FROM entries), b AS (SELECT dataset, block, count(*) AS n, sum(v) AS s FROM dealt GROUP BY ALL),
w AS (SELECT replicate, dataset, n, s, {_U} AS u FROM b, range(10000) AS t(replicate)),
x AS (SELECT *, (u >= 0.36787944117144233::DOUBLE)::INT + (u >= 0.7357588823428847::DOUBLE)::INT + (u >= 0.9196986029286058::DOUBLE)::INT + (u >= 0.9810118431238462::DOUBLE)::INT + (u >= 0.9963401531726563::DOUBLE)::INT AS w FROM w),
y AS (SELECT replicate, dataset, sum(w * n) AS w, sum(w * s) AS ws, sum(n) AS n FROM x GROUP BY ALL), m AS (SELECT replicate, sum(n * ws / w) / sum(n) AS mean FROM y WHERE w > 0 GROUP BY replicate)
SELECT round(quantile_cont(mean, 0.025), 6) AS low, round(quantile_cont(mean, 0.975), 6) AS high, count(*) AS replicates FROM m""")
def bootstrap_ci(spark, d):
    rows = R.entries(spark, d).withColumn("hit", (F.col("truth") == F.col("pred")).cast("double"))
    ci = evaluate.bootstrap(rows, "instance", "hit", ["dataset"])
    return ci.select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "replicates")


@query()
def bootstrap_paired(spark, d):
    """10,000 resamples of the difference of two predictors' accuracies, on the same entries."""
    rows = R.entries(spark, d).select("dataset", "truth", "pred", (F.col("score") >= 3000).cast("long").alias("other"))
    cells = evaluate.resample_cells([(t, p, o) for t in (0, 1) for p in (0, 1) for o in (0, 1)])
    seen = evaluate.resample_cells([tuple(r) for r in rows.select("truth", "pred", "other").distinct().collect() if tuple(r) in cells])
    gain = [(t == p) - (t == o) for t, p, o in seen]
    return evaluate.resample(rows, ["dataset"], ["truth", "pred", "other"], lambda n: n @ gain / n.sum(axis=1))


_P = "ps AS (SELECT p_brand AS family, p_partkey AS test, CASE WHEN p_partkey % 17 > 0 THEN (p_retailprice % 100) / 1000.0::DOUBLE END AS p FROM part)"


def _tests(spark, d):
    return R.table(spark, d, "part").select(F.col("p_brand").alias("family"), F.col("p_partkey").alias("test"), F.when(F.col("p_partkey") % 17 > 0, (F.col("p_retailprice") % 100) / 1000.0).alias("p"))


@query(f"WITH {_P}, s AS (SELECT *, least(1.0::DOUBLE, p * (count(*) OVER (PARTITION BY family) - row_number() OVER w + 1)) AS step FROM ps WHERE p IS NOT NULL WINDOW w AS (PARTITION BY family ORDER BY p, test)) SELECT family, test, round(max(step) OVER (PARTITION BY family ORDER BY p, test ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM s UNION ALL SELECT family, test, NULL FROM ps WHERE p IS NULL")
def holm(spark, d):
    """Families of which every 17th test has no p-value."""
    return evaluate.holm(_tests(spark, d), "p", ["family"], "test").select("family", "test", F.round("adjusted", 6).alias("adjusted"))


@query(f"WITH {_P}, s AS (SELECT *, least(1.0::DOUBLE, p * count(*) OVER (PARTITION BY family) / row_number() OVER w) AS step FROM ps WHERE p IS NOT NULL WINDOW w AS (PARTITION BY family ORDER BY p, test)) SELECT family, test, round(min(step) OVER (PARTITION BY family ORDER BY p, test ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS adjusted FROM s UNION ALL SELECT family, test, NULL FROM ps WHERE p IS NULL")
def bh(spark, d):
    return evaluate.benjamini_hochberg(_tests(spark, d), "p", ["family"], "test").select("family", "test", F.round("adjusted", 6).alias("adjusted"))


@query(f"WITH {R.PREDICTED} SELECT split, generator, dataset, count(*) AS n, round(avg((truth = pred)::INT), 6) AS accuracy, round({_macro('truth', 'pred')}, 6) AS macro_f1, count(*) >= 20 AS headline_ok FROM predicted GROUP BY GROUPING SETS ((split), (split, generator), (dataset), ())")
def sliced_metrics(spark, d):
    card = evaluate.scorecard(R.predicted(spark, d), "truth", "pred", [["split"], ["split", "generator"], ["dataset"], []], 20)
    return card.withColumn("accuracy", F.round("accuracy", 6)).withColumn("macro_f1", F.round("macro_f1", 6))


@query("SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS missing, 0::BIGINT AS unknown, count(*) FILTER (WHERE l.doc_id % 10 = 0) AS repeated, count(*) FILTER (WHERE l.doc_id IS NULL) = 0 AND count(*) FILTER (WHERE l.doc_id % 10 = 0) = 0 AS conformant FROM documents d LEFT JOIN labels l USING (doc_id)")
def coverage_conformance(spark, d):
    predictions = R.table(spark, d, "labels").select("doc_id")
    return evaluate.coverage(predictions.unionAll(predictions.where("doc_id % 10 = 0")), R.table(spark, d, "documents"), "doc_id")


_GRAMS = "list_distinct(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' ')))"


@query(f"""WITH b AS (SELECT DISTINCT unnest({_GRAMS}) AS gram FROM (SELECT string_split(text, ' ') AS w FROM benchmark)), g AS (SELECT doc_id, unnest({_GRAMS}) AS gram FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))
SELECT doc_id, count(*) AS shared FROM g WHERE gram IN (SELECT gram FROM b) GROUP BY doc_id""")
def contamination(spark, d):
    return descriptives.contamination(R.table(spark, d, "documents"), "doc_id", R.table(spark, d, "benchmark"))


@query(f"WITH {R.PREDICTED} SELECT dataset, qtype, label, count(*) AS n FROM predicted GROUP BY CUBE (dataset, qtype, label)")
def composition_cube(spark, d):
    return R.predicted(spark, d).cube("dataset", "qtype", "label").agg(F.count("*").alias("n"))


_STATE = "CASE WHEN label = 'faithful' THEN 'S3' WHEN reason = 'D1' THEN 'S1' ELSE 'S2' END"
_SEALED = f"""sealed AS (SELECT instance, CASE WHEN instance % 41 = 0 THEN 'faithful' ELSE label END AS label, reason AS reason_code, {_STATE} AS state, CASE WHEN instance % 43 <> 0 THEN split END AS split, scene, dataset, CASE WHEN instance % 47 <> 0 THEN generator END AS generator,
 CASE {_STATE} WHEN 'S1' THEN 1 ELSE 3 END AS flip_count, CASE WHEN ({_STATE} = 'S3') <> (instance % 53 = 0) THEN 60 ELSE 20 END AS drift FROM (SELECT * FROM predicted UNION ALL SELECT * FROM predicted WHERE instance % 40 = 0))"""
_LEGAL = "coalesce((state = 'S1' AND label = 'unfaithful' AND reason_code = 'D1') OR (state = 'S2' AND label = 'unfaithful' AND reason_code = 'D2') OR (state = 'S3' AND label = 'faithful' AND reason_code IS NULL), false)"


def _sealed(spark, d):
    """Sealed entries with their provenance, of which some are repeated, mislabelled, without a split or a generator, or off their provenance."""
    i, rows = F.col("instance"), R.predicted(spark, d)
    rows = rows.unionAll(rows.where("instance % 40 = 0"))
    state = F.when(F.col("label") == "faithful", "S3").when(F.col("reason") == "D1", "S1").otherwise("S2")
    rows = rows.withColumn("state", state).withColumnRenamed("reason", "reason_code")
    return rows.withColumns({
        "label": F.when(i % 41 == 0, "faithful").otherwise(F.col("label")), "split": F.when(i % 43 != 0, F.col("split")), "generator": F.when(i % 47 != 0, F.col("generator")), "source": F.col("scene"), "spec_versions": F.array(F.lit("1.0")),
        "flip_count": F.when(F.col("state") == "S1", 1).otherwise(3), "k": F.lit(3), "drift": F.when((F.col("state") == "S3") != (i % 53 == 0), 60).otherwise(20), "theta": F.lit(R.THETA),
    })


def _n(check: str, where: str) -> str:
    return f"SELECT '{check}' AS \"check\", count(*) AS violations FROM {where}"


_STANDARD = " UNION ALL ".join((
    _n("one_entry_per_instance", "(SELECT instance FROM sealed GROUP BY instance HAVING count(*) > 1)"), _n("label_table", f"sealed WHERE NOT {_LEGAL}"), _n("split_present", "sealed WHERE split IS NULL"),
    _n("scene_in_one_split", "(SELECT scene FROM sealed WHERE split IN ('train', 'validation') GROUP BY scene HAVING count(DISTINCT split) > 1)"),
))
_CORPUS = " UNION ALL ".join((
    _n("DF1", "(SELECT scene FROM sealed WHERE split <> 'ood-model' GROUP BY scene HAVING count(DISTINCT split) > 1)"),
    _n("DF2", "(SELECT dataset FROM sealed WHERE dataset IS NOT NULL GROUP BY dataset HAVING bool_or(split = 'ood-dataset') AND bool_or(split <> 'ood-dataset'))"),
    _n("DF3", "(SELECT generator FROM sealed WHERE generator IS NOT NULL GROUP BY generator HAVING bool_or(split = 'ood-model') AND bool_or(split <> 'ood-model'))"),
    _n("DF4", "(SELECT split FROM sealed WHERE split IS NOT NULL GROUP BY split HAVING avg((label = 'faithful')::INT) < 0.05 OR avg((label = 'faithful')::INT) > 0.95)"),
    _n("LF2", f"sealed WHERE NOT {_LEGAL} OR (state IN ('S2', 'S3') AND flip_count < 3)"),
    _n("LF3", f"sealed WHERE CASE WHEN flip_count < 3 THEN 'S1' WHEN drift >= {R.THETA} THEN 'S3' ELSE 'S2' END IS DISTINCT FROM state"),
    _n("LF4", "(SELECT DISTINCT p.instance FROM predicted p LEFT JOIN sealed s USING (instance) WHERE p.instance % 40 = 0 UNION ALL SELECT instance FROM predicted WHERE instance % 59 = 0 AND instance % 40 <> 0)"),
))
_SOURCES = _n("traceability", "sealed WHERE generator IS NULL")


@query(f"WITH {R.PREDICTED}, {_SEALED} SELECT *, violations = 0 AS passed FROM ({_STANDARD})")
def assurance_checks(spark, d):
    return assurance.release_report(assurance.standard_checks(_sealed(spark, d)))


@query(f"WITH {R.PREDICTED}, {_SEALED} SELECT sum(violations) = 0 AS releasable, sum(violations)::BIGINT AS violations FROM ({_STANDARD})")
def release_rollup(spark, d):
    return assurance.releasable(assurance.release_report(assurance.standard_checks(_sealed(spark, d))))


def _corpus_checks(spark, d):
    """The checks of the corpus; one in 59 candidates has no outcome."""
    sealed = _sealed(spark, d)
    return assurance.corpus_checks(sealed, R.predicted(spark, d), sealed.where("instance % 59 <> 0 or instance % 40 = 0"), "instance")


@query(f"WITH {R.PREDICTED}, {_SEALED} SELECT *, violations = 0 AS passed FROM ({_CORPUS})")
def corpus_checks(spark, d):
    return assurance.release_report(_corpus_checks(spark, d))


_RUNS = [(0, ["question", "rationale"], ["train"], False, "image and text", "v1", []), (1, ["question"], ["train"], False, "text", "v1", []), (2, ["question", "label"], ["train"], False, "text", "v1", []),
         (3, ["question"], ["train", "validation"], False, None, "v1", []), (4, ["question"], [], True, "text", "v0", ["label"]), (5, ["question"], [], False, "text", "v1", [])]


_CONFORMANCE = """WITH t AS (SELECT doc_id AS instance, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), p AS (SELECT r AS run, instance, CASE WHEN r = 2 THEN pos + 1 ELSE pos END AS pos FROM t, range(5) AS x(r) WHERE r <> 1 OR instance % 10 <> 0 UNION ALL SELECT 3, -1, -1),
k AS (SELECT run, count(*) = (SELECT count(*) FROM t) AND count(DISTINCT p.instance) = (SELECT count(*) FROM t) AND count(t.instance) = count(*) AND count(*) FILTER (WHERE t.pos <> p.pos) = 0 AS k1 FROM p LEFT JOIN t USING (instance) GROUP BY run),
d(run, k2, k3, k4, k5) AS (VALUES (0, true, true, true, true), (1, true, true, true, true), (2, false, true, true, true), (3, false, false, true, true), (4, false, true, false, false), (5, true, true, true, true)),
j AS (SELECT d.run::BIGINT AS run, coalesce(k1, false) AS k1, k2, k3, k4, k5 FROM d LEFT JOIN k USING (run)) SELECT *, concat_ws(',', CASE WHEN NOT k1 THEN 'K-1' END, CASE WHEN NOT k2 THEN 'K-2' END, CASE WHEN NOT k3 THEN 'K-3' END, CASE WHEN NOT k4 THEN 'K-4' END, CASE WHEN NOT k5 THEN 'K-5' END) AS broken, k1 AND k2 AND k3 AND k4 AND k5 AS conformant FROM j"""


@query(_CONFORMANCE)
def run_conformance(spark, d):
    """Six runs: one conforms, the others miss, move or add instances, read what they mustn't, declare nothing, or give no prediction."""
    truth = identity.assign_position(R.table(spark, d, "documents").select(F.col("doc_id").alias("instance")), "instance")
    n = F.col("run")
    given = truth.crossJoin(F.broadcast(spark.range(5).withColumnRenamed("id", "run"))).where((n != 1) | (F.col("instance") % 10 != 0))
    given = given.select("run", "instance", F.when(n == 2, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos")).unionAll(spark.createDataFrame([(3, -1, -1)], "run long, instance long, pos long"))
    declared = spark.createDataFrame(_RUNS, "run long, columns array<string>, fit_splits array<string>, queried_generator boolean, access string, corpus_version string, overrides array<string>")
    return evaluate.conformance(given, truth, declared, views.PREDICTOR, "v1")


_PAIRS_OF_CORE = "(SELECT a.score AS n, b.score AS p FROM (SELECT *, row_number() OVER (PARTITION BY dataset, qtype, truth ORDER BY md5(instance::VARCHAR), instance) AS rn FROM predicted) a JOIN (SELECT *, row_number() OVER (PARTITION BY dataset, qtype, truth ORDER BY md5(instance::VARCHAR), instance) AS rn FROM predicted) b USING (dataset, qtype, rn) WHERE a.truth = 0 AND b.truth = 1)"
_RECORDED, _FOUND = "SELECT split, label, instance, reason FROM predicted", "SELECT split, label, instance, reason_code FROM sealed"
_MADE = " UNION ALL ".join((
    _n("conformance", f"({_CONFORMANCE}) WHERE NOT conformant"),
    _n("label_stability", "(SELECT avg((instance % 11 = 0 OR instance % 31 = 0)::INT) AS flips FROM predicted) WHERE flips > 0.02"),
    _n("hard_core_collapse", f"(SELECT avg(CASE WHEN p > n THEN 1.0 WHEN p = n THEN 0.5 WHEN p < n THEN 0.0 END) AS share FROM {_PAIRS_OF_CORE}) WHERE share IS NULL OR share > 0.55"),
    _n("boundary", f"({_WHOLE}) WHERE NOT passed"),
    _n("manifest", f"(SELECT DISTINCT split, label FROM (({_RECORDED} EXCEPT ALL {_FOUND}) UNION ALL ({_FOUND} EXCEPT ALL {_RECORDED})))"),
))
_CRITERIA = " UNION ALL ".join(f"SELECT '{b}' AS criterion, '{c}' AS \"check\"" for b, cs in assurance.CRITERIA.items() for c in cs)
_BLOCKING = f"""{_LABELS}, made AS ({_CORPUS} UNION ALL {_SOURCES} UNION ALL {_MADE}), rests AS ({_CRITERIA}), blocking AS (SELECT criterion, coalesce(sum(violations), 0)::BIGINT AS violations, count(*) FILTER (WHERE violations IS NULL) AS missing FROM rests LEFT JOIN made USING ("check") GROUP BY criterion),
judged AS (SELECT *, violations = 0 AND missing = 0 AS cleared FROM blocking)"""


def _release_checks(spark, d):
    """All checks, each over rows that break it, but the analysis plan, which nobody has made."""
    rows, sealed, i = R.predicted(spark, d), _sealed(spark, d), F.col("instance")
    again = rows.where(i % 31 != 0).select("instance", F.when(i % 11 == 0, "other").otherwise(F.col("label")).alias("label"))
    digests = lambda df, reason: assurance.entry_digests(df, ["split", "label"], ["instance", "label", reason])
    made = [
        *_corpus_checks(spark, d), assurance.violations("traceability", assurance.untraceable(sealed)),
        assurance.violations("conformance", assurance.nonconformant(run_conformance(spark, d))),
        assurance.violations("label_stability", assurance.unstable(rows, again, "instance", "label", 0.02)),
        assurance.violations("hard_core_collapse", assurance.easy_core(hard_core(spark, d), rows, "instance", "score", 0.55)),
        assurance.violations("boundary", assurance.breaches(_whole_report(spark, d))),
        assurance.violations("manifest", assurance.manifest_differences(digests(rows, "reason"), digests(sealed, "reason_code"), ["split", "label"])),
    ]
    return assurance.release_report(made).select("check", "violations")


@query(f"WITH {R.PREDICTED}, {_SEALED}, {_LABELS}, made AS ({_CORPUS} UNION ALL {_SOURCES} UNION ALL {_MADE}) SELECT * FROM made")
def release_checks(spark, d):
    return _release_checks(spark, d)


@query(f"WITH {R.PREDICTED}, {_SEALED}, {_BLOCKING} SELECT * FROM judged")
def release_criteria(spark, d):
    return assurance.blocking(_release_checks(spark, d))


@query(f"WITH {R.PREDICTED}, {_SEALED}, {_BLOCKING} SELECT bool_and(cleared) AS releasable, string_agg(criterion, ',' ORDER BY criterion) FILTER (WHERE NOT cleared) AS blocked_by FROM judged")
def release_verdict(spark, d):
    return assurance.release(_release_checks(spark, d))


def _f_rows(name: str, rows: str, t: str, p: str) -> str:
    """Macro-F1 of each split with its interval."""
    cell = lambda a, b: f"count(*) FILTER (WHERE {t} = {a} AND {p} = {b})::DOUBLE"
    return f"""SELECT split, '{name}' AS metric, f AS value, greatest(0.0::DOUBLE, f - spread) AS low, least(1.0::DOUBLE, f + spread) AS high, n FROM (SELECT *, 1.96 * sqrt(greatest(0.0::DOUBLE, tp * g1 * g1 + tn * g0 * g0 + (fp + fn) * go * go - n * pow((tp * g1 + tn * g0 + (fp + fn) * go) / n, 2))) AS spread FROM (SELECT *,
 coalesce((fp + fn) / nullif(pow(2 * tp + fp + fn, 2), 0), 0) AS g1, coalesce((fp + fn) / nullif(pow(2 * tn + fp + fn, 2), 0), 0) AS g0, -coalesce(tp / nullif(pow(2 * tp + fp + fn, 2), 0), 0) - coalesce(tn / nullif(pow(2 * tn + fp + fn, 2), 0), 0) AS go,
 ({_F1.format('tp', 'fp', 'fn')} + {_F1.format('tn', 'fn', 'fp')}) / 2 AS f FROM (SELECT split, {cell(1, 1)} AS tp, {cell(0, 1)} AS fp, {cell(1, 0)} AS fn, {cell(0, 0)} AS tn, count(*) AS n FROM {rows} GROUP BY split)))"""


_HITS = "SELECT split, avg((truth = pred)::INT) AS p, count(*) AS n FROM predicted GROUP BY split"


@query(f"""WITH {R.PREDICTED}, scored AS (SELECT split, score AS s, truth AS t FROM predicted), a AS ({_AUC.format(by='split,', part='PARTITION BY split', group='GROUP BY split').replace('round(sum(wins) / nullif(sum(pos) * sum(neg), 0)::DOUBLE, 6)', 'sum(wins) / nullif(sum(pos) * sum(neg), 0)::DOUBLE')}),
v AS (SELECT *, 1.96 * sqrt(greatest(0.0::DOUBLE, auroc * (1 - auroc) + (n_pos - 1) * (auroc / (2 - auroc) - auroc * auroc) + (n_neg - 1) * (2 * auroc * auroc / (1 + auroc) - auroc * auroc)) / nullif(n_pos::DOUBLE * n_neg, 0)) AS se FROM a),
u AS (SELECT split, (reason = 'D1')::BIGINT AS t, pred AS p FROM predicted WHERE label = 'unfaithful'),
every AS (SELECT split, 'accuracy' AS metric, p AS value, greatest(0.0::DOUBLE, (p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) AS low, least(1.0::DOUBLE, (p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n)) AS high, n FROM (SELECT split, p, n::DOUBLE AS n FROM ({_HITS}))
 UNION ALL {_f_rows('macro_f1', 'predicted', 'truth', 'pred')} UNION ALL SELECT split, 'auroc', auroc, greatest(0.0::DOUBLE, CASE WHEN auroc IS NOT NULL THEN auroc - se END), least(1.0::DOUBLE, auroc + se), n_pos + n_neg FROM v UNION ALL {_f_rows('reason_f1', 'u', 't', 'p')})
SELECT split, metric, round(value, 6) AS value, round(CASE WHEN value IS NOT NULL THEN low END, 6) AS low, round(CASE WHEN value IS NOT NULL THEN high END, 6) AS high, n::BIGINT AS n, 'v1' AS corpus_version, n >= 20 AS headline_ok FROM every""")
def metric_table(spark, d):
    card = evaluate.metric_table(R.predicted(spark, d), "truth", "pred", "score", "v1", 20, "reason")
    ok = F.col("value").isNotNull()
    return card.select("split", "metric", F.round("value", 6).alias("value"), F.round(F.when(ok, F.col("low")), 6).alias("low"), F.round(F.when(ok, F.col("high")), 6).alias("high"), "n", "corpus_version", "headline_ok")


# --- streaming, batch twins --------------------------------------------------------------------------------


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys FROM events GROUP BY event_type")
def ledger_stream(spark, d):
    """The event log streamed twice into one ledger; each key is there once."""
    root = Scratch(spark, "ledger").path("stream")
    schema = R.table(spark, d, "events").schema
    for turn in range(2):
        rows = spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/events.parquet*").select("event_id", "user_id", "event_type")
        streams.commit_stream(rows, f"{root}/log", "event_id", f"{root}/checkpoint-{turn}").awaitTermination()
    return spark.read.parquet(f"{root}/log").groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("keys"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS keys, sum(length(props))::BIGINT AS chars FROM events GROUP BY event_type")
def keyed_log(spark, d):
    """Events committed twice to a log of JSON lines, read back as a stream of byte ranges."""
    root = Scratch(spark, "keyed-log").path("log")
    events = R.table(spark, d, "events").select(F.col("event_id").cast("string").alias("key"), F.to_json(F.struct("event_type", "props")).alias("payload"))
    for _ in range(2):
        log_source.commit_log(events, f"{root}/log")
    log_source.stream_log(spark, f"{root}/log").writeStream.format("parquet").option("path", f"{root}/rows").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{root}/rows").select("key", F.from_json("payload", "event_type string, props string").alias("p"))
    return rows.groupBy("p.event_type").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"), F.sum(F.length("p.props")).alias("chars"))


_SEALS = """WITH e AS (SELECT user_id::VARCHAR AS instance, event_id AS seq, CASE WHEN event_id % 37 = 0 THEN 'seal' ELSE 'append' END AS kind FROM events), s AS (SELECT instance, min(seq) AS sealed_at FROM e WHERE kind = 'seal' GROUP BY instance)
SELECT kind, coalesce(seq <= sealed_at, true) AS accepted, count(*) AS n FROM e LEFT JOIN s USING (instance) GROUP BY ALL"""


def _appended(events):
    kind = F.when(F.col("event_id") % 37 == 0, "seal").otherwise("append")
    return events.select(F.col("user_id").cast("string").alias("instance"), F.col("event_id").alias("seq"), kind.alias("kind"))


@query(_SEALS)
def sealed_log(spark, d):
    return streams.sealed_log_batch(_appended(R.table(spark, d, "events"))).groupBy("kind", "accepted").agg(F.count("*").alias("n"))


@query(_SEALS)
def sealed_log_stream(spark, d):
    """The same judged by the stream, with its state."""
    root = Scratch(spark, "seals").path("stream")
    events = spark.readStream.schema(R.table(spark, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parquet*")
    streams.judged_log(_appended(events), f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/log").groupBy("kind", "accepted").agg(F.count("*").alias("n"))


_ARTIFACTS = """WITH e AS (SELECT user_id::VARCHAR AS instance, event_id AS seq, CASE WHEN event_id % 37 = 0 THEN 'seal' WHEN event_id % 29 = 0 THEN 'observation' ELSE 'determination' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'E1' ELSE event_type END AS payload FROM events),
m AS (SELECT instance, min(seq) FILTER (WHERE kind = 'seal' AND payload = 'E1') AS e1, min(seq) FILTER (WHERE kind = 'seal' AND payload IS DISTINCT FROM 'E1') AS other, min(seq) FILTER (WHERE kind = 'observation') AS seen FROM e GROUP BY instance),
s AS (SELECT instance, least(CASE WHEN seen IS NULL OR e1 < seen THEN e1 END, other) AS sealed_at FROM m),
j AS (SELECT e.*, CASE WHEN seq IS NULL OR seq > sealed_at THEN 'rejected' WHEN sealed_at IS NULL THEN 'open' WHEN kind = 'seal' AND seq < sealed_at THEN 'refused' ELSE 'sealed' END AS status FROM e LEFT JOIN s ON e.instance IS NOT DISTINCT FROM s.instance)
SELECT instance, kind, status, count(*) AS n, sum(seq)::BIGINT AS seqs FROM j WHERE {} GROUP BY ALL"""


def _entries_to_seal(events):
    """Events as entries of their user's artifact; one in 37 is a seal, a third of these of E1."""
    i = F.col("event_id")
    kind = F.when(i % 37 == 0, "seal").when(i % 29 == 0, "observation").otherwise("determination")
    return events.select(F.col("user_id").cast("string").alias("instance"), i.alias("seq"), kind.alias("kind"), F.when(i % 3 == 0, "E1").otherwise(F.col("event_type")).alias("payload"))


def _by_status(judged):
    return judged.groupBy("instance", "kind", "status").agg(F.count("*").alias("n"), F.sum("seq").alias("seqs"))


@query(_ARTIFACTS.format("true"))
def sealed_artifacts(spark, d):
    return _by_status(artifacts.statuses(_entries_to_seal(R.table(spark, d, "events"))))


@query(_ARTIFACTS.format("status <> 'open'"))
def sealed_artifacts_stream(spark, d):
    """The same from the stream, which emits an artifact when it is sealed and keeps open ones as state."""
    root = Scratch(spark, "artifacts").path("stream")
    events = spark.readStream.schema(R.table(spark, d, "events").schema).parquet(f"{d.rstrip('/')}/events.parquet*")
    artifacts.seal_stream(_entries_to_seal(events), f"{root}/log", f"{root}/checkpoint").awaitTermination()
    return _by_status(spark.read.parquet(f"{root}/log"))


# --- descriptives and remaining joins ----------------------------------------------------------------------


_CUT = "array_to_string(list_slice(regexp_extract_all({0}, '[^ \\n]+'), 1, least(len(regexp_extract_all(baseline, '[^ \\n]+')), len(regexp_extract_all(counterfactual, '[^ \\n]+')))), ' ')"


@query(f"""WITH {R.PAIRS}, cut AS (SELECT instance, {_CUT.format('baseline')} AS a, {_CUT.format('counterfactual')} AS b FROM pairs), worded AS (SELECT *, {R.sql_words('a')} AS p, {R.sql_words('b')} AS q FROM cut)
SELECT instance, round(CASE WHEN len(list_distinct(list_concat(p, q))) = 0 THEN 0.0::DOUBLE ELSE 1 - len(list_intersect(p, q))::DOUBLE / len(list_distinct(list_concat(p, q))) END, 9) AS drift FROM worded""")
def length_robust_drift(spark, d):
    return R.pairs(spark, d).select("instance", F.round(descriptives.length_robust_drift(F.col("baseline"), F.col("counterfactual")), 9).alias("drift"))


@query(f"WITH {R.PAIRS}, w AS (SELECT {R.sql_words('baseline')} AS p, {R.sql_words('counterfactual')} AS q FROM pairs) SELECT count(*) AS n, count(*) FILTER (WHERE len(list_intersect(list_slice(list_sort(p), 1, 3), q)) = 0) AS dropped FROM w")
def evidence_mention_flip(spark, d):
    return R.pairs(spark, d).agg(F.count("*").alias("n"), F.count_if(descriptives.mentions_dropped(F.col("baseline"), F.col("counterfactual"))).alias("dropped"))


@query(f"WITH {R.RESOLVED} SELECT count(*) AS n, round(avg((res = CASE WHEN res = 'S3' AND drift < 50 THEN 'S2' ELSE res END)::INT), 6) AS agreement FROM resolved")
def label_stability(spark, d):
    """Agreement of outcomes with those derived again under a larger theta."""
    first = R.resolved(spark, d)
    again = first.select("instance", F.when((F.col("res") == "S3") & (F.col("drift") < 50), "S2").otherwise(F.col("res")).alias("res"))
    return descriptives.agreement(first, again, "instance", "res").withColumn("agreement", F.round("agreement", 6))


@query(f"WITH {R.PREDICTED} SELECT split, count(DISTINCT generator) AS generators, count(DISTINCT scene) AS scenes, count(DISTINCT dataset) AS datasets, count(DISTINCT qtype) AS qtypes FROM predicted GROUP BY split")
def diversity_counts(spark, d):
    return R.predicted(spark, d).groupBy("split").agg(*(F.countDistinct(c).alias(f"{c}s") for c in ("generator", "scene", "dataset", "qtype")))


@query("SELECT n_nationkey, count(c_custkey) AS entries, count(DISTINCT c_mktsegment) AS sources FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def bidirectional_trace(spark, d):
    entries = R.table(spark, d, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return descriptives.trace(R.table(spark, d, "nation"), entries, "n_nationkey", "c_custkey", {"sources": F.countDistinct("c_mktsegment")})


@query("SELECT 'orders' AS origin, count(*) AS n FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def union_of_files(spark, d):
    return descriptives.origins({n: R.table(spark, d, n) for n in ("orders", "lineitem")})


@query("SELECT (SELECT count(*) FROM (SELECT lang FROM documents EXCEPT SELECT x FROM (VALUES ('en'), ('de'), ('xx')) AS g(x))) AS beyond, (SELECT count(*) FROM (SELECT x FROM (VALUES ('en'), ('de'), ('xx')) AS g(x) EXCEPT SELECT lang FROM documents)) AS unmet")
def grid_equality(spark, d):
    """The languages that occur against a registered list of three."""
    return descriptives.grid_equality(R.table(spark, d, "documents"), "lang", ["en", "de", "xx"])


@query(f"WITH {R.RESOLVED}, c AS (SELECT instance FROM resolved WHERE res LIKE 'S%' OR instance % 29 = 0), r AS (SELECT instance FROM resolved WHERE res LIKE 'E%' AND instance % 23 <> 0) SELECT (SELECT count(*) FROM c) AS corpus, (SELECT count(*) FROM r) AS routed, (SELECT count(*) FROM c JOIN r USING (instance)) AS both, (SELECT count(*) FROM resolved WHERE instance NOT IN (SELECT instance FROM c UNION ALL SELECT instance FROM r)) AS lost")
def corpus_and_routed(spark, d):
    """Corpus and routed-aside sets, of which some entries are in both and some candidates in neither."""
    res = R.resolved(spark, d)
    corpus, routed = res.where("res like 'S%' or instance % 29 = 0"), res.where("res like 'E%' and instance % 23 <> 0")
    return descriptives.partition_check(res, {"corpus": corpus, "routed": routed}, "instance")


@query("""SELECT event_type, median(value) AS med, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM events GROUP BY event_type""".replace("median(value) AS med", "round(median(value), 6) AS med").replace("quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr", "round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) AS iqr"))
def median_and_iqr(spark, d):
    found = calibrate.median_iqr(R.table(spark, d, "events"), "value", ["event_type"])
    return found.select("event_type", F.round("median", 6).alias("med"), F.round("iqr", 6).alias("iqr"))


@query(f"WITH {R.READINGS} SELECT instance, count(*) AS regimes, max(scores[1]) AS top FROM readings GROUP BY instance")
def regime_map(spark, d):
    """Long readings to one map for each instance and back to long; folded again."""
    back = descriptives.unpacked_readings(descriptives.packed_readings(R.readings(spark, d)))
    return back.groupBy("instance").agg(F.count("*").alias("regimes"), F.max(F.get("scores", F.lit(0))).alias("top"))
