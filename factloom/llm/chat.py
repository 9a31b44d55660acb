"""Multi-party chat formatting by perspective rotation (operator 6), by DataFrame functions only.

For every speaker of a conversation (every role but `system`) the dialogue is rendered with that speaker as the assistant,
the other speakers as users with their names, and system turns as they are. The mask holds the stretches to train on: text
and end mark of that speaker's turns.

Turns stand in the order of turn number, then of a short digest of role and text, then of role and text. A dialogue is
rendered in parts of TURNS turn numbers, and a part with more than ROWS rows in pieces of ROWS rows. Rows with texts are shuffled twice: to
the rows of their turn number and digest, and to their piece; they are never shuffled by conversation alone, so a long one is dealt out by
its pieces. A row's place in its part is a sum of counts of the turn numbers and digests before it, of which a part has a bounded
number. A piece's mask counts code points from its start; `at` is where the piece starts in the whole dialogue, which is
the pieces joined in order: it comes from sums of lengths, one small row for each piece, role and speaker.

Null texts count as empty. A null role is a speaker named `unknown` who is never the assistant, whether another speaker has
that name or not. Null conversation ids form one conversation; null turns come first, in part -1. Repeated rows are rendered
as often as they come. Conversations of system turns alone have no speaker and give no row. In texts and names `<|` is
written `< |`, and line ends in names are blanks, so no turn can forge a mark or a head. An empty table gives none; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.store import table

TURNS, ROWS = 64, 256
DIGESTS = 2  # hex digits of the digest that splits rows of one turn number
START, END = "<|im_start|>", "<|im_end|>"


def _safe(text: Column) -> Column:
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def _head(role: Column, mine: Column) -> Column:
    return F.concat(F.lit(START), F.when(mine, F.lit("assistant")).when(role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))


def _named(c: Column) -> Column:
    """A value as text that is never null, so that null keys are joined and grouped like others."""
    return F.coalesce(F.concat(F.lit("k"), c.cast("string")), F.lit("none"))


def _placed(t: DataFrame, per_piece: int) -> DataFrame:
    """Adds the piece that a row of a part is in."""
    group = ["conv", "part", "turn_key", "digest"]
    n = t.groupBy(*group).agg(F.count("*").alias("n"), F.first("turn").alias("turn"))
    w = Window.partitionBy("conv", "part").orderBy(F.col("turn").asc_nulls_first(), "digest")
    before = n.select(*group, (F.sum("n").over(w) - F.col("n")).alias("before"))
    own = F.row_number().over(Window.partitionBy(*group).orderBy("role", "nameless", "said"))
    return t.withColumn("own", own).join(before, group).withColumn("piece", F.floor((F.col("before") + F.col("own") - 1) / per_piece).cast("long")).drop("own", "before", "turn_key")


def _starts(placed: DataFrame) -> DataFrame:
    """conv, part, piece, speaker, at: where each piece starts for each speaker, from lengths alone."""
    piece = ["conv", "part", "piece"]
    n = placed.groupBy(*piece, "role", "nameless").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    line = lambda mine: F.length(_head(F.col("role"), F.lit(mine))) + len(END) + 1
    n = table(n.withColumns({"other": F.col("size") + F.col("n") * line(False), "mine": F.col("size") + F.col("n") * line(True)}), "lengths")
    named = n.where("role <> 'system' and not nameless")
    speakers = named.select("conv", F.col("role").alias("speaker")).distinct()
    each = n.groupBy(*piece).agg(F.sum("other").alias("length")).join(speakers, "conv")
    own = named.select(*piece, F.col("role").alias("speaker"), (F.col("mine") - F.col("other")).alias("more"))
    d = each.join(own, [*piece, "speaker"], "left").withColumn("length", F.col("length") + F.coalesce("more", F.lit(0)))
    return d.select(*piece, "speaker", (F.sum("length").over(Window.partitionBy("conv", "speaker").orderBy("part", "piece")) - F.col("length")).alias("at"))


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", per_part: int = TURNS, per_piece: int = ROWS) -> DataFrame:
    """conv_id, speaker, part, piece, at, n_turns, text, mask (`start:length` of each stretch, joined by commas), n_trained."""
    role = F.translate(_safe(F.col(role_col)), "\r\n", "  ")
    t = turns.select(_named(F.col(conv_col)).alias("conv"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.when(F.col(role_col).isNull(), "unknown").otherwise(role).alias("role"), _safe(F.col(text_col)).alias("said"), F.col(role_col).isNull().alias("nameless"))
    t = t.withColumns({"part": F.coalesce(F.floor(F.col("turn") / per_part), F.lit(-1)).cast("long"), "turn_key": _named(F.col("turn")), "digest": F.left(F.md5(F.concat_ws("\n", "role", "said").cast("binary")), F.lit(DIGESTS))})
    placed = table(_placed(t, per_piece).withColumn("size", F.length("said").cast("long")), "placed")
    both = placed.join(table(_starts(placed), "starts"), ["conv", "part", "piece"])  # each turn once for each speaker, where its piece is
    both = both.withColumn("mine", (F.col("role") == F.col("speaker")) & ~F.col("nameless")).withColumn("head", _head(F.col("role"), F.col("mine")))
    line = F.struct("turn", "digest", "role", "nameless", "said", "head", "mine")
    key = ["conv", "speaker", "part", "piece"]
    parts = both.groupBy(*key).agg(F.array_sort(F.collect_list(line)).alias("lines"), F.first("conv_id").alias("conv_id"), F.first("at").alias("at"))
    whole = lambda x: F.concat(x["head"], x["said"], F.lit(END + "\n"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        head, own = F.length(x["head"]), F.length(x["said"]) + len(END)
        span = F.concat_ws(":", (acc["at"] + head).cast("string"), own.cast("string"))
        return F.struct((acc["at"] + head + own + 1).alias("at"), F.when(x["mine"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"), (acc["n"] + F.when(x["mine"], own).otherwise(0)).alias("n"))

    done = parts.withColumn("m", F.aggregate("lines", start, step))
    return done.select("conv_id", *key[1:], "at", F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform("lines", whole), "").alias("text"), F.array_join("m.spans", ",").alias("mask"), F.col("m.n").alias("n_trained"))


SQL = f"""
WITH r AS (SELECT conv_id, turn, role IS NULL AS nameless, coalesce(replace(replace(replace(role, '<|', '< |'), chr(13), ' '), chr(10), ' '), 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS said FROM conversations),
t AS (SELECT *, coalesce(CAST(floor(turn / {TURNS}) AS BIGINT), -1) AS part, left(md5(role || chr(10) || said), {DIGESTS}) AS digest FROM r),
q AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST, digest, role, nameless, said) - 1) // {ROWS} AS piece FROM t),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system' AND NOT nameless),
b AS (SELECT q.*, s.speaker, role = speaker AND NOT nameless AS mine FROM q JOIN s ON q.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (SELECT *, '{START}' || CASE WHEN mine THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head FROM b),
l AS (SELECT *, head || said || '{END}' || chr(10) AS line FROM h),
o AS (SELECT *, row_number() OVER w AS k, sum(length(line)) OVER (w ROWS UNBOUNDED PRECEDING) - length(line) + length(head) AS pos
      FROM l WINDOW w AS (PARTITION BY conv_id, speaker, part, piece ORDER BY turn NULLS FIRST, digest, role, nameless, said)),
g AS (SELECT conv_id, speaker, part, piece, count(*) AS n_turns, string_agg(line, '' ORDER BY k) AS text,
  coalesce(string_agg(CASE WHEN mine THEN CAST(pos AS BIGINT) || ':' || (length(said) + {len(END)}) END, ',' ORDER BY k), '') AS mask,
  CAST(sum(CASE WHEN mine THEN length(said) + {len(END)} ELSE 0 END) AS BIGINT) AS n_trained
FROM o GROUP BY conv_id, speaker, part, piece)
SELECT conv_id, speaker, part, piece, CAST(sum(length(text)) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece) - length(text) AS BIGINT) AS at, n_turns, text, mask, n_trained FROM g
"""
