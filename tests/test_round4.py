"""Faults that larger tables or other plans showed."""

from pyspark.sql import functions as F

from factloom.plans import metrics as metric_plans


def test_lines_beyond_the_fifth_have_no_field(spark):
    """Whatever order the filters run in: the field alone, without one on the line's number."""
    got = spark.range(1, 8).select("id", metric_plans._extracted(F.col("id"))["field"].alias("f")).where("f is not null").collect()
    assert sorted(r["id"] for r in got) == [1, 2, 3, 4, 5]


def test_labels_by_their_first_letters(spark):
    """Patterns are tried only where a label's first two letters fit, and find what trying each of them finds."""
    from factloom.operators import extract

    texts = ["ISIN: XS1", "(a) Issue Date: 1/2/2020", "12. Código ISIN ES1", "b) Índice de referencia: x", "ıssue date: x", "Status of the Noteſ: Senior", "ſtrike Price: 5", "€STR", "Interest Basis: Fixed", "Nothing", "", "I", " (iv) Rate of Interest 5", "ÍNDICE DE REFERENCIA", "Tipo de interés: 5%", "3 Cap: 4", "margin: x", "Knock-in Barrier: 60%"]
    rules = extract.RULES
    d = spark.createDataFrame([(t,) for t in texts], "t string").select("t", extract._labels([F.col("t")], rules).alias("x"), F.array_compact(F.array(*(F.when(F.col("t").rlike(extract.pattern(r)), F.struct(F.lit(n).alias("field"), F.regexp_extract("t", extract.pattern(r), 1).alias("sep"), F.trim(F.regexp_extract("t", extract.pattern(r), 2)).alias("value"))) for n, r in rules.items()))).alias("want"), F.bit_count(extract._may_open(F.col("t"), rules)).alias("tried"))
    rows = d.collect()
    for r in rows:
        assert [(x["field"], x["sep"], x["value"]) for x in r["x"]] == [tuple(x) for x in r["want"]], r["t"]
    assert sum(len(r["x"]) for r in rows) > 12
    assert all(r["tried"] <= 8 for r in rows if r["t"].isascii())
    assert extract._heads("Ab?c") is None and extract._heads("Ab|Cd") is None and extract._heads(r"\b[CD]ode(?:x|y)") == {"co", "do"}


def test_hot_families_are_joined_by_broadcast(spark):
    """A family with most rows goes to no single task; families that are NULL or absent stay as a plain join leaves them."""
    from factloom.operators import graphs

    rows = spark.range(5000).select("id", F.when(F.col("id") < 2500, -1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id")).cast("long").alias("family"))
    facts = rows.where("family is not null and family % 3 <> 0").select("family").distinct().withColumn("x", F.col("family") * 2)
    hot = graphs._hot(rows)
    assert hot == [-1]
    for how in ("inner", "left"):
        got = sorted((r["id"], r["family"], r["x"]) for r in graphs._by_family(rows, facts, hot, how).collect())
        assert got == sorted((r["id"], r["family"], r["x"]) for r in rows.join(facts, "family", how).select("id", "family", "x").collect())
    assert graphs._hot(rows.where("id < 0")) == []


def test_no_score_is_shuffled(spark):
    """Tiles are added where shards meet: what is shuffled for a block is its shards, in as few bytes as hold them, and chunks give what whole vectors give."""
    import numpy as np

    from factloom.llm import negatives

    rng = np.random.default_rng(3)
    big = [1.0] * 100 + [1000.0] * 10 + [128.0] * 10  # 128 * 256 = 2^15: one more than two bytes hold
    rows = [(i, i % 3, [float(x) for x in rng.normal(size=7 if i % 2 else 5) * big[i % 120]]) for i in range(360)] + [(900, 0, [-128.0] * 7), (901, 1, [-128.0] * 7)]
    d = spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>")
    whole, parts = (sorted(map(tuple, negatives.mine(d, anchors=8, block=32, chunk=c).collect())) for c in (64, 2))
    assert whole == parts and len(whole) > 10
    few = spark.createDataFrame([(1, 0, 0, [3] * 64), (2, 1, 0, [4] * 64)], "id long, uid long, label long, v array<long>")
    shards = negatives._blocked(few, 8, 32, False).collect()
    assert [(r["k"], r["size"], len(r["part"])) for r in sorted(shards, key=lambda r: r["k"])] == [(0, 2, 2 * 32 * 2), (1, 2, 2 * 32 * 2)]
