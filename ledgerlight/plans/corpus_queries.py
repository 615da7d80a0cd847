"""Queries of corpora, contrasts and responses over a folder of tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.inference import RESAMPLES
from ..operators import catalog, conversation, corpus, evaluation, profiles, questions, ranking, search
from ..operators.search import Constraint
from ..sources import fingerprint
from .catalog_queries import EAV, OUTCOMES, PAIRS, PARTS, SCORE, SUMMARY, _draws, _score, outcomes, pairs, part_attributes, products, query, scenario_of, table

# ---- catalog ----

FEATURED = "SELECT p_partkey AS id, p_brand AS brand, lower(split_part(p_name, ' ', 1)) AS w1, lower(split_part(p_name, ' ', 2)) AS w2 FROM part"


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    features = F.array(F.concat(F.lit("Color: "), F.split("p_name", " ")[0], F.lit("; new")), F.concat(F.lit("size: "), "p_size"), F.concat(F.lit("100% "), "p_name"))
    details = F.array(F.struct(F.lit("brand").alias("key"), F.col("p_brand").alias("value")))
    return part.select(F.col("p_partkey").alias("id"), "p_name", features.alias("features"), details.alias("details"))


@query(f"""WITH f AS ({FEATURED}), m AS (SELECT w2 FROM f GROUP BY 1 HAVING count(*) >= 2), c AS (SELECT w1 FROM f WHERE length(w1) BETWEEN 2 AND 25 GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT id, list_filter([{{'key': 'brand', 'value': brand}}, CASE WHEN w2 IN (SELECT w2 FROM m) THEN {{'key': 'material', 'value': w2}} END, CASE WHEN w1 IN (SELECT w1 FROM c) THEN {{'key': 'color', 'value': w1}} END], lambda x: x IS NOT NULL) AS d FROM f)
SELECT id, CAST(generate_subscripts(d, 1) - 1 AS INTEGER) AS position, unnest(d).key AS key, unnest(d).value AS value FROM d""")
def folded_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = featured(spark, sf_dir)
    vocabulary = catalog.material_vocabulary(items.select("id", F.lit("material").alias("attribute"), F.split("p_name", " ")[1].alias("value")))
    out = catalog.folded_details(items, vocabulary, catalog.known_keyed_values(catalog.keyed_pairs(items)))
    return out.select("id", F.posexplode("details").alias("position", "d")).select("id", "position", "d.key", "d.value")


CARD_TEXT = "concat_ws(' ', p_name, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'soft cotton' END, CASE WHEN p_partkey % 4 = 0 THEN 'in Blue' END)"


@query(f"""WITH t AS (SELECT p_partkey AS id, p_name AS title, p_type, p_size, p_retailprice AS price, lower(regexp_extract({CARD_TEXT}, '(?i)\\b(cotton|polyester|nylon|leather|wool|spandex|silk|rayon|fabric)\\b', 1)) AS m,
  lower(regexp_extract({CARD_TEXT}, '(?i)\\b(black|white|blue|red|pink|green|brown|gray|grey|purple|yellow|orange)\\b', 1)) AS c FROM part),
o AS (SELECT *, [concat('made for ', p_type), concat('size ', p_size), concat('type: ', p_type)] AS own, CASE WHEN c <> '' THEN concat('color: ', c) END AS tint FROM t),
x AS (SELECT *, CASE WHEN m <> '' THEN list_concat([m, tint], own) ELSE list_concat(own[1:1], [tint], own[2:3]) END AS l FROM o),
y AS (SELECT id, title, list_filter(list_concat(l, [CASE WHEN price IS NOT NULL THEN concat('budget around $', price) END]), lambda z: z IS NOT NULL) AS l FROM x)
SELECT id, title AS target_category, array_to_string(l[1:2], '|') AS hard, array_to_string(CASE WHEN len(l) > 2 THEN l[3:4] ELSE l[1:1] END, '|') AS soft FROM y""")
def intent_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    extra = F.concat_ws(" ", "p_name", "p_type", F.when(F.col("p_partkey") % 3 == 0, "soft cotton"), F.when(F.col("p_partkey") % 4 == 0, "in Blue"))
    features = F.array(F.concat(F.lit("made for "), "p_type"), F.concat(F.lit("  size "), "p_size", F.lit(" - ")))
    details = F.array(F.struct(F.lit("type").alias("key"), F.col("p_type").alias("value")), F.struct(F.lit("none").alias("key"), F.lit("").alias("value")))
    card = corpus.intent_card(F.col("p_name"), features, details, extra, F.col("p_retailprice"))
    rows = part.select(F.col("p_partkey").alias("id"), card.alias("card"))
    return rows.select("id", "card.target_category", F.array_join("card.hard_constraints", "|").alias("hard"), F.array_join("card.soft_preferences", "|").alias("soft"))


@query(f"SELECT id, attribute, value FROM ({EAV}) JOIN (SELECT attribute, value FROM ({EAV}) GROUP BY 1, 2 HAVING count(*) >= 10) USING (attribute, value)")
def target_gist(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_attributes(products(spark, sf_dir))
    return corpus.target_gist(rows, catalog.gist_vocabulary(rows))


@query("SELECT p_partkey AS id, concat(lower(p_type), '|', CASE WHEN p_retailprice - 890 < 20 THEN 'under_20' WHEN p_retailprice - 890 < 50 THEN 'under_50' WHEN p_retailprice - 890 < 100 THEN 'under_100' ELSE 'over_100' END) AS stratum FROM part")
def stratum_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), corpus.stratum(F.array(F.lit(" Clothing "), F.lit(""), "p_type"), F.col("p_retailprice") - 890).alias("stratum"))


BOUNDS = [
    Constraint("budget", "950", "greater_than_or_equal", id="low"), Constraint("budget", "1000", "less_than_or_equal", id="high"),
    Constraint("budget", "960", "less_than_or_equal", excluded=True, id="not_below"), Constraint("budget", "971", "equals", excluded=True, id="not_equal"),
]


@query("SELECT p_partkey AS id FROM (SELECT *, CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 10 = 1 THEN 971 ELSE p_retailprice END AS price FROM part) WHERE price >= 950 AND price <= 1000 AND NOT price <= 960 AND price <> 971")
def price_bound_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    price = F.when(F.col("p_partkey") % 10 == 0, F.lit(None)).when(F.col("p_partkey") % 10 == 1, F.lit(971.0)).otherwise(F.col("p_retailprice"))
    items = part.select(F.col("p_partkey").alias("id"), price.alias("price"))
    return search.hard_filter(items, items.select("id", F.lit("none").alias("attribute"), F.lit("").alias("value")), BOUNDS).select("id")


@query(f"WITH p AS ({PARTS}) SELECT id, style FROM p SEMI JOIN (SELECT id FROM ({EAV}) WHERE (attribute = 'color' AND value IN ('red', 'blue')) OR (attribute = 'style' AND value = 'LARGE')) USING (id)")
def soft_target_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = products(spark, sf_dir)
    return search.soft_target(items, part_attributes(items), [("color", "red"), ("color", "blue"), ("style", "LARGE")]).select("id", "style")


@query("SELECT o_custkey AS list, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pos) AS rank FROM (SELECT o_custkey, 1 + o_orderkey % 3000 AS id, min(o_orderkey) AS pos FROM orders GROUP BY 1, 2) SEMI JOIN (SELECT p_partkey AS id FROM part) USING (id)) WHERE rank <= 3")
def first_known_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list"), (F.lit(1) + F.col("o_orderkey") % 3000).alias("id"), F.col("o_orderkey").alias("pos"))
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return ranking.first_known(orders, known, 3, ["list"]).select("list", "id", "rank")


@query("""WITH s AS (SELECT DISTINCT p_partkey AS id, 0 AS ordinal FROM part WHERE p_size = 7 AND p_brand = 'Brand#11'), r AS (SELECT p_partkey AS id, 1 AS ordinal FROM part WHERE p_size = 7 UNION ALL SELECT p_partkey, 2 FROM part WHERE p_brand = 'Brand#11'),
f AS (SELECT id, min(ordinal) AS ordinal FROM (SELECT * FROM s UNION ALL SELECT * FROM r) GROUP BY 1), n AS (SELECT ordinal, sum(count(*)) OVER (ORDER BY ordinal) - count(*) AS before FROM f GROUP BY 1)
SELECT id, CAST(ordinal AS INTEGER) AS ordinal FROM f JOIN n USING (ordinal) WHERE before < 60""")
def tail_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id")
    small, brand = F.col("p_size") == 7, F.col("p_brand") == "Brand#11"
    relaxed = part.where(small).select("id", F.lit(1).alias("ordinal")).union(part.where(brand).select("id", F.lit(2)))
    return ranking.fill_tail(part.where(small & brand).select("id"), relaxed, 60).select("id", "ordinal")


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN [1, 2, 3, 4] ELSE [3, 4] END AS shown FROM supplier")
def shown_slates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = lambda *v: F.array(*[F.lit(x) for x in v])
    shown = ranking.rotate_shown(ids(1, 2, 3), F.lit(1).cast("bigint"), F.when(F.col("s_suppkey") % 3 == 0, 1).otherwise(2), ids(3, 4))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), shown.alias("shown"))


@query(f"SELECT p.id, p.style AS value, CAST(coalesce(v.n, 0) AS BIGINT) AS document_frequency FROM ({PARTS}) p LEFT JOIN (SELECT value, count(*) AS n FROM ({EAV}) WHERE attribute = 'style' GROUP BY 1 HAVING count(*) % 2 = 0) v ON p.style = v.value")
def value_frequency_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = products(spark, sf_dir)
    counts = catalog.value_counts(part_attributes(items)).where("attribute = 'style' and n % 2 = 0").select("value", "n")
    return items.select("id", F.col("style").alias("value")).join(counts, "value", "left").select("id", "value", F.coalesce("n", F.lit(0)).alias("document_frequency"))


@query("SELECT doc_id AS id, array_to_string(list_sort(list_intersect(['the', 'and', 'thing', 'der', 'zzz'], list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')))), ' ') AS terms FROM documents WHERE text IS NOT NULL")
def profile_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "thing", "der", "zzz")])
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.col("doc_id").alias("id"), F.array_join(ranking.grounded_terms(wanted, F.col("text")), " ").alias("terms"))


# ---- responses and sessions ----


@query("""SELECT p_partkey AS id, concat('Here are the strongest matches for your current preferences.', CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' The final options are near matches that relax your size requirement.'
ELSE ' The final options are near matches that relax your size, brand requirement.' END, CASE WHEN p_size > 25 THEN ' Which color would you prefer?' ELSE '' END) AS message FROM part""")
def recommendation_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    relaxed = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("size"), F.lit("size"))).otherwise(F.array(F.lit("size"), F.lit("brand"), F.lit("size")))
    prompt = F.when(F.col("p_size") > 25, questions.PROMPTS["color"])
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ranking.recommendation_message(relaxed, prompt).alias("message"))


@query("""SELECT s_suppkey AS id, concat('{"message":"m","ask_attribute":', CASE WHEN s_suppkey % 2 = 0 THEN '"color"' ELSE 'null' END, ',"recommendations":[{"parent_asin":"', s_suppkey, '"},{"parent_asin":"', s_nationkey, '"}],"usage":{"prompt_tokens":0,"completion_tokens":0}}') AS payload FROM supplier""")
def response_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "supplier")
    asked = F.when(F.col("s_suppkey") % 2 == 0, "color")
    ids = F.array(F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string"))
    return rows.select(F.col("s_suppkey").alias("id"), ranking.response_payload(F.lit("m"), asked, ids).alias("payload"))


@query("""SELECT conv_id AS session, turn, len(h) AS n, md5(array_to_string(h, '|')) AS digest FROM (SELECT conv_id, turn, list(text) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS h FROM conversations)""")
def trailing_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), "turn", "text")
    out = conversation.trailing_history(said)
    return out.select("session", "turn", F.size("history").cast("bigint").alias("n"), F.md5(F.array_join("history", "|")).alias("digest"))


@query("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'budget' ELSE 'size' END AS attribute, CASE WHEN p_partkey % 6 = 0 THEN ' ' ELSE p_size::VARCHAR END AS value, CASE WHEN p_partkey % 5 = 0 THEN 'less_than_or_equal' ELSE 'equals' END AS operator,
  CASE WHEN p_partkey % 2 = 0 THEN 'hard' ELSE 'soft' END AS strength, p_size / 40.0::DOUBLE AS confidence FROM part),
v AS (SELECT id, unnest([CASE WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range' END, CASE WHEN strength = 'hard' AND confidence < 0.90 THEN 'uncertain_hard' END, CASE WHEN trim(value) = '' THEN 'empty_value' END,
  CASE WHEN attribute = 'budget' AND try_cast(value AS DOUBLE) IS NULL THEN 'budget_not_a_number' END, CASE WHEN operator <> 'equals' AND attribute <> 'budget' THEN 'bound_without_budget' END]) AS violation FROM c)
SELECT * FROM v WHERE violation IS NOT NULL""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k.alias("id"), F.when(k % 4 == 0, "budget").otherwise("size").alias("attribute"), F.when(k % 6 == 0, " ").otherwise(F.col("p_size").cast("string")).alias("value"),
        F.when(k % 5 == 0, "less_than_or_equal").otherwise("equals").alias("operator"), F.lit(False).alias("excluded"), F.when(k % 2 == 0, "hard").otherwise("soft").alias("strength"), (F.col("p_size") / 40.0).alias("confidence"),
    )
    return conversation.constraint_violations(rows)


# ---- contrasts ----


@query("""WITH a AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'N'), b AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R')
SELECT 'shared' AS side, CAST(count(*) AS BIGINT) AS n FROM a SEMI JOIN b USING (k) UNION ALL SELECT 'control', CAST(count(*) AS BIGINT) FROM a ANTI JOIN b USING (k) UNION ALL SELECT 'probe', CAST(count(*) AS BIGINT) FROM b ANTI JOIN a USING (k)""")
def shared_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    arm = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("pair_id")).distinct()
    control, _, dropped = evaluation.restrict_to_shared(arm("N"), arm("R"))
    return control.select(F.lit("shared").alias("side")).union(dropped.select("side")).groupBy("side").agg(F.count("*").alias("n"))


@query(f"""WITH {PAIRS}, x AS (SELECT CASE WHEN sample_id % 20 = 0 THEN 'boundary' WHEN sample_id % 20 <= 8 THEN 'browsing' WHEN sample_id % 20 <= 16 THEN 'buying' ELSE 'intent_override' END AS scenario, ah, bh FROM pairs)
SELECT scenario, CAST(count(*) AS BIGINT) AS pairs, round((sum(bh) - sum(ah)) / count(*), 9) AS hit_rate_delta, CAST(count(*) FILTER (ah <> bh) AS BIGINT) AS discordant, round(sqrt(sum(ah) / count(*) * (1 - sum(ah) / count(*)) / count(*)), 9) AS standard_error FROM x GROUP BY 1""")
def contrast_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.contrast_scenarios(pairs(spark, sf_dir).withColumn("scenario", scenario_of("sample_id")))
    return out.select("scenario", "pairs", F.round("hit_rate_delta", 9).alias("hit_rate_delta"), "discordant", F.round("standard_error", 9).alias("standard_error"))


@query(f"""WITH {PAIRS}, {_draws(0)}, d AS (SELECT rep, draw % n AS pos FROM drawn, n),
x AS (SELECT rep, {_score('bh', 'br', 'bv')} - {_score('ah', 'ar', 'av')} AS delta FROM d JOIN pairs USING (pos) GROUP BY 1), y AS (SELECT delta, row_number() OVER (ORDER BY delta, rep) - 1 AS k FROM x),
m AS (SELECT count(*) AS n, count(*) FILTER (ah = 1 AND bh = 0) AS b, count(*) FILTER (ah = 0 AND bh = 1) AS c, {_score('bh', 'br', 'bv')} - {_score('ah', 'ar', 'av')} AS delta FROM pairs),
t AS (SELECT least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM (SELECT unnest(range(least(b, c) + 1)) AS i))) AS p FROM m)
SELECT CAST(n AS BIGINT) AS pair_count, CAST(0 AS BIGINT) AS dropped_pair_count, CAST(b AS BIGINT) AS favouring_control, CAST(c AS BIGINT) AS favouring_probe, round((b + c) / n, 6) AS discordance_rate, round((c - b) / n, 6) AS hit_rate_delta,
  round(p, 6) AS mcnemar_p, round(m.delta, 6) AS delta, round((SELECT delta FROM y WHERE k = 249), 6) AS low, round((SELECT delta FROM y WHERE k = 9750), 6) AS high, round((SELECT stddev_pop(delta) FROM x), 6) AS standard_error FROM m, t""")
def paired_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.paired_contrast(pairs(spark, sf_dir), RESAMPLES)
    real = ("discordance_rate", "hit_rate_delta", "mcnemar_p", "delta", "low", "high", "standard_error")
    return out.select("pair_count", "dropped_pair_count", "favouring_control", "favouring_probe", *[F.round(c, 6).alias(c) for c in real])


@query()
def adjudication(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other event type as a candidate against purchases, over all sessions, with all replicates."""
    baseline, rows = outcomes(spark, sf_dir), None
    kinds = ("signup", "click", "view", "error")
    summary = lambda df: df.agg(*evaluation.summary_columns())
    own = summary(baseline).select(*[F.col(c).alias(f"a_{c}") for c in ("hit_rate", "mrr", "mttc")])
    for kind in kinds:
        arm = outcomes(spark, sf_dir, kind)
        both = evaluation.paired(baseline, arm)
        observed = both.agg((evaluation.score_of("b") - evaluation.score_of("a")).alias("delta"))
        se = evaluation.bootstrap_replicates(both, RESAMPLES).agg(F.stddev_pop("delta").alias("standard_error"))
        reps = evaluation.permutation_replicates(both, RESAMPLES).withColumnRenamed("delta", "d").crossJoin(F.broadcast(observed))  # one row
        p = reps.agg(((F.sum((F.abs("d") >= F.abs("delta") - 1e-12).cast("bigint")) + 1) / (F.count("*") + 1)).alias("p_value"))
        moved = summary(arm).crossJoin(own).select(*[(F.col(c) - F.col(f"a_{c}")).alias(f"{c}_delta") for c in ("hit_rate", "mrr", "mttc")])
        line = observed.crossJoin(se).crossJoin(p).crossJoin(moved).select(F.lit(kind).alias("name"), F.sha2(F.lit(kind), 256).alias("fingerprint"), "*")  # a row each
        rows = line if rows is None else rows.union(line)
    return evaluation.adjudicate(rows, len(kinds))


@query(f"""WITH {OUTCOMES}, x AS (SELECT *, CAST(sample_id % 3 AS BIGINT) AS corpus FROM s), m AS (SELECT corpus, {SUMMARY}, CAST(count(DISTINCT scenario) AS BIGINT) AS scenarios FROM x GROUP BY 1)
SELECT corpus, sample_count, hit_rate, mrr, mttc, {SCORE} AS technical_score, scenarios FROM m""")
def corpus_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = evaluation.corpus_baselines(outcomes(spark, sf_dir).withColumn("corpus", F.col("sample_id") % 3))
    return out.select("corpus", "sample_count", "hit_rate", "mrr", "mttc", "technical_score", "scenarios")


@query("""WITH f AS (SELECT bool_or(event_type = 'error') AS incompatible, bool_or(event_type = 'view' AND value > 60) AS in_population, bool_or(event_type = 'click' AND value < 1) AS route_failed FROM events GROUP BY user_id)
SELECT unnest(['incompatible', 'in_population', 'route_failed']) AS class, unnest([count(*) FILTER (incompatible), count(*) FILTER (in_population), count(*) FILTER (route_failed)]) AS n FROM f""")
def miss_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, v = F.col("event_type"), F.col("value")
    flags = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(e == "error").alias("incompatible"), F.bool_or((e == "view") & (v > 60)).alias("in_population"), F.bool_or((e == "click") & (v < 1)).alias("route_failed"))
    return evaluation.miss_classes(flags, "incompatible", "in_population", "route_failed")


@query(f"WITH {OUTCOMES} SELECT sample_id, hit, CASE WHEN NOT hit AND sample_id % 2 = 0 THEN concat('r', sample_id % 5) END AS miss_reason FROM s")
def annotated_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = outcomes(spark, sf_dir)
    failures = sessions.where(~F.col("hit") & (F.col("sample_id") % 2 == 0)).select("sample_id", F.concat(F.lit("r"), F.col("sample_id") % 5).alias("reason"))
    return evaluation.with_failures(sessions, failures).select("sample_id", "hit", "miss_reason")


# ---- corpora ----


@query("SELECT s_suppkey AS pair, CAST(('0x' || substr(md5(concat('turn|', s_suppkey, '|intent_override')), 1, 8))::UBIGINT % 2 + 3 AS INTEGER) AS turn FROM supplier")
def override_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(pair.alias("pair"), corpus.override_turn(pair, F.lit("intent_override")).alias("turn"))


@query("""WITH g AS (SELECT l_orderkey AS pair, count(*) AS n, bool_or(l_returnflag = 'R') AS c, bool_or(l_returnflag = 'A') AS a FROM lineitem GROUP BY 1)
SELECT pair, 'orphan' AS violation FROM g WHERE c AND NOT a UNION ALL SELECT pair, 'not_three_rows' FROM g WHERE c AND n <> 3""")
def cross_check_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_returnflag").alias("arm"))
    return corpus.cross_check_violations(lines, "pair", "arm", "R", "A")


@query("""WITH p AS (SELECT c_custkey AS id, concat('s', c_nationkey % 4) AS scenario FROM customer), z AS (SELECT scenario, count(*) AS size FROM p GROUP BY 1), n AS (SELECT sum(size) AS n FROM z),
f AS (SELECT scenario, 60 * size // n AS fl, 60 * size % n AS rest FROM z, n), q AS (SELECT scenario, fl + (row_number() OVER (ORDER BY rest DESC, scenario) <= 60 - (SELECT sum(fl) FROM f))::INT AS quota FROM f)
SELECT id, scenario FROM (SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY md5('cross|' || id), id) AS k FROM p) JOIN q USING (scenario) WHERE k <= quota""")
def cross_check_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("s"), F.col("c_nationkey") % 4).alias("scenario"))
    return corpus.stratified_sample(rows, 60, "cross", "id", "scenario").select("id", "scenario")


@query("SELECT CAST(count(*) AS BIGINT) AS dropped_constraint_rows, CAST(count(DISTINCT l_partkey) AS BIGINT) AS dropped_constraints, (SELECT CAST(count(*) AS BIGINT) FROM orders WHERE o_orderkey % 9 = 0) AS refused_pairs FROM lineitem WHERE l_quantity < 5")
def drop_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dropped = table(spark, sf_dir, "lineitem").where("l_quantity < 5").select(F.col("l_partkey").alias("item_id"))
    return corpus.drop_summary(dropped, table(spark, sf_dir, "orders").where("o_orderkey % 9 = 0").select(F.col("o_orderkey").alias("pair_id")))


@query("SELECT l_orderkey AS pair, CAST(count(DISTINCT (l_returnflag, l_linestatus)) AS BIGINT) AS constraints FROM lineitem GROUP BY 1")
def constraints_per_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair"), F.col("l_returnflag").alias("slot"), F.col("l_linestatus").alias("position"))
    return corpus.constraints_per_pair(lines)


@query("SELECT l_partkey AS id FROM lineitem WHERE l_quantity < 3 UNION SELECT p_partkey FROM part WHERE p_size = 7 UNION SELECT s_suppkey FROM supplier")
def exclusion_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "lineitem").where("l_quantity < 3").select(F.col("l_partkey").alias("id"))
    b, c = table(spark, sf_dir, "part").where("p_size = 7").select(F.col("p_partkey").alias("id")), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return corpus.exclusions(a, b, c, key="id")


@query("SELECT l_orderkey AS corpus, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS models FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) <> 1")
def several_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("corpus"), F.col("l_returnflag").alias("model"))
    return corpus.several_models(records, "corpus").select("corpus", F.array_join("models", ",").alias("models"))


# ---- wordings by rounds ----


def wordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three attempts at wording each part's color anew, with a review by size; parts of a brand are a pair."""
    part = table(spark, sf_dir, "part")
    w, size = F.split("p_name", " "), F.col("p_size").cast("string")
    tries = F.array(
        F.concat(w[0], F.lit(" tone")), F.concat(F.when(F.col("p_size") % 2 == 0, F.lit("wool ")).otherwise(F.lit("")), w[0], F.lit(" shade "), F.floor(F.col("p_size") / 10).cast("string")),
        F.when(F.col("p_size") % 5 > 0, F.concat(F.lit("hue "), w[0], F.lit(" no "), size)),
    )
    target = F.concat_ws(" ", "p_name", F.lower("p_brand"), F.lower("p_type"), F.concat(F.lit("size "), size))
    rows = part.select(F.col("p_partkey").alias("item"), F.col("p_brand").alias("pair"), w[0].alias("control"), target.alias("target"), "p_size", F.posexplode(tries).alias("attempt", "phrase"))
    return rows.withColumn("faithful", (F.col("p_size") + F.col("attempt")) % 3 != 0).drop("p_size")


@query()
def phrase_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.phrase_rounds(wordings(spark, sf_dir), ["wool", "tone 7"])


# ---- fingerprints ----

_FINGERPRINTED = {"nation": "n_name n_nationkey n_regionkey", "part": "p_brand p_name p_partkey p_size p_type", "conversations": "conv_id role text turn"}


def _root_sql(name: str, columns: str) -> str:
    row = "to_json({" + ", ".join(f"'{c}': {c}" for c in columns.split()) + "})"
    quarters = ", ".join(f"sum(('0x' || substr(d, {16 * i + 1}, 16))::UBIGINT::HUGEINT)" for i in range(4))
    return f"""SELECT '{name}' AS name, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(line, chr(10) ORDER BY line)) AS digest FROM (
SELECT count(*) AS n, concat_ws(':', substr(d, 1, 2), count(*), {quarters}) AS line FROM (SELECT sha256({row}::VARCHAR) AS d FROM {name}) GROUP BY substr(d, 1, 2))"""


@query(" UNION ALL ".join(_root_sql(n, c) for n, c in _FINGERPRINTED.items()))
def content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and digest of three tables' columns."""
    every = [fingerprint.root(fingerprint.buckets(table(spark, sf_dir, n).select(*c.split()))).select(F.lit(n).alias("name"), "rows", "digest") for n, c in _FINGERPRINTED.items()]
    return every[0].unionByName(every[1]).unionByName(every[2])


# ---- profiles and rules ----


def _u(name: str) -> str:
    return f"((('0x' || substr(sha256(seed || chr(0) || '{name}'), 1, 13))::UBIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def _choice(name: str, shares) -> str:
    total, upto, out = sum(w for _, w in shares), 0, "CASE"
    for value, w in shares:
        upto += w
        out += f" WHEN {_u(name)} * {total} < {upto} THEN {value}"
    return out + " END"


@query(f"""WITH s AS (SELECT p_partkey AS target, sha256(p_partkey || chr(0) || 'probe_v1_' || lpad((p_partkey % 10000)::VARCHAR, 4, '0') || chr(0) || '{profiles.PROFILE_LABEL}') AS seed FROM part),
d AS (SELECT *, {_choice("#rating", [(f"'{s}'", w) for s, _, w in profiles.RATINGS])} AS rating_style, {_choice("#rating", [(f"{r}::DOUBLE", w) for _, r, w in profiles.RATINGS])} AS rating,
  {_choice("#tags", profiles.TAG_COUNTS)} AS n, list_sort([{", ".join(f"{{'at': -ln({_u(t)}) / {float(w)}::DOUBLE, 'name': '{t}'}}" for t, w in profiles.TAGS)}]) AS tags FROM s)
SELECT target, rating_style, rating, array_to_string(list_transform(tags[1:n], lambda x: x.name), ', ') AS tags,
  'Prior purchases emphasize ' || array_to_string(list_transform(tags[1:n], lambda x: x.name), ', ') || '; ratings are ' || rating_style || '.' AS summary FROM d""")
def profile_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("target"), profiles.pair_id(profiles.corpus_stem(F.lit("probe.v1")), F.col("p_partkey") % 10000).alias("pair_id"))
    p = profiles.profile_draws(pairs)
    return p.select("target", "user_profile.rating_style", F.col("user_profile.average_prior_rating").alias("rating"), F.array_join("user_profile.preference_tags", ", ").alias("tags"), "user_profile.summary")


def corpus_rows(spark: SparkSession, sf_dir: str, spoiled: bool = True) -> DataFrame:
    """A corpus of parts, two arms a part; if spoiled, a part's size says which rules its rows break."""
    part = table(spark, sf_dir, "part").withColumn("pair_id", profiles.pair_id(F.lit("parts_v1"), F.col("p_partkey") % 10000)).withColumn("target", F.col("p_partkey").cast("string"))
    n = F.pmod(F.xxhash64("p_partkey"), F.lit(64)) if spoiled else F.lit(63)
    rows = profiles.profile_draws(part).withColumn("n", n).withColumn("arm", F.explode(F.array(F.lit("control"), F.when(F.col("n") == 0, "other").otherwise("probe_haiku"))))
    w = F.split("p_name", " ")
    kind = F.element_at(F.array(*[F.lit(s) for s in profiles.SCENARIOS]), F.pmod(F.xxhash64("pair_id"), F.lit(4)).cast("int") + 1)
    long, at = F.repeat(F.lit("x"), 181), lambda k, a, b: F.when(F.col("n") == k, a).otherwise(b)
    rows = rows.withColumn("kind", at(1, F.lit("unheard"), kind)).withColumn("hard", F.array(w[0], F.lower("p_brand"))).withColumn("soft", F.array(w[1], F.concat(F.lit("size "), "p_size")))
    hard = F.when(F.col("n") == 2, F.array().cast("array<string>")).when(F.col("n") == 3, F.array(F.lit(" "))).when(F.col("n") == 4, F.array(F.lit(" x"))).when(F.col("n") == 5, F.array(long)).otherwise(F.col("hard"))
    soft = F.when(F.col("n") == 6, F.lit(None)).when(F.col("n") == 7, F.array(F.lit(""))).when(F.col("n") == 8, F.array(F.lit("x "))).when(F.col("n") == 9, F.array(long)).when(F.col("n") == 10, F.col("hard")).otherwise(F.col("soft"))
    override = F.struct(
        at(11, F.lit(1), F.lit(3)).alias("turn"), F.col("soft")[1].alias("old_value"), at(12, F.lit("elsewhere"), F.col("hard")[0]).alias("new_value"), at(13, F.lit(" "), F.lit("Actually")).alias("message"),
    )
    moved = at(14, F.lit("buying"), F.col("kind"))
    profile = F.col("user_profile")
    profile = profile.withField("average_prior_rating", at(15, F.lit(5.5), profile["average_prior_rating"])).withField("summary", at(16, F.lit(" "), profile["summary"]))
    profile = profile.withField("preference_tags", F.when(F.col("n") == 17, F.lit(None)).when(F.col("n") == 18, F.array(F.lit(" "))).otherwise(profile["preference_tags"]))
    return rows.select(
        at(19, F.concat(F.lit("z"), F.concat_ws("_", "pair_id", "arm")), at(20, F.lit(""), F.concat_ws("_", "pair_id", "arm"))).alias("sample_id"), F.col("kind").alias("scenario_type"),
        at(21, F.lit(""), F.lit("clothing")).alias("category_bucket"),
        at(22, F.lit("odd"), F.create_map(*[F.lit(x) for p in profiles.DIFFICULTY.items() for x in p])[F.col("kind")]).alias("difficulty_bucket"),
        F.struct(at(23, F.lit(None), F.col("target")).alias("parent_asin")).alias("ground_truth"), profile.alias("user_profile"),
        F.struct(F.when(F.col("n") == 24, F.lit("")).when(F.col("n") == 25, long).otherwise(w[1]).alias("target_category"), hard.alias("hard_constraints"), soft.alias("soft_preferences")).alias("intent_card"),
        F.struct(moved.alias("scenario_type"), F.when((moved == "intent_override") & ~F.col("n").isin(26, 29, 30, 31, 32, 33) | F.col("n").isin(11, 12, 13, 27), override).alias("override")).alias("behavior"),
        at(28, F.lit("parts_7"), F.col("pair_id")).alias("pair_id"), "arm",
    )


@query()
def corpus_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profiles.corpus_violations(corpus_rows(spark, sf_dir))
