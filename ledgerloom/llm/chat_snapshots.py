"""Chat formatting: logged snapshots of one growing conversation collapse into the longest.

A conversation logged after every turn is there many times, each a prefix of the next. A prefix is
identified by its length and three sums over its turns of hashes that include the turn's place, so
all prefixes come from running sums. Conversations that are a proper prefix of another are removed by
an anti join, equal ones are merged, and only what remains is read again with its texts and rendered.
DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, read_table

# Turns of one conversation that are ordered in one task; running sums are carried from block to block.
BLOCK = 64
LANES = ("__h1", "__h2", "__h3")
# 40-bit lanes: sums stay exact up to 8 million turns, and three of them tell 2**120 prefixes apart.
LANE_BITS = 40

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(END))


def _turns(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Turns without nulls; __key is the conversation's id as a text that is never null, so that joins keep the dealing."""
    return df.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("__key"),
        F.col(conv_col).alias("__conv"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit(-(1 << 62))).alias("__turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("__role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"),
    )


def _before(*columns: str) -> list[Column]:
    """Sums of the columns over the earlier blocks of the conversation, named with a b in front."""
    before = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    return [F.coalesce(F.sum(x).over(before), F.lit(0)).alias("b" + x) for x in columns]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """__key, __conv, __n (turns so far), __total and the lanes of every prefix of every conversation.

    turns has __key, __conv, __turn, __role, __text. Exact repeats of a turn count once; turns of one
    number are ordered by role and a hash of the text. Turns are dealt by conversation and block once:
    places and running sums inside blocks, and the blocks' totals, come from the same exchange.
    """
    rows = turns.select(
        "__key", "__conv", "__turn", F.xxhash64("__role", "__text").alias("__own"), F.xxhash64("__text", "__role", F.lit(7)).alias("__own2"),
        F.floor(F.col("__turn") / BLOCK).alias("__block"),
    )
    place = ["__key", "__block"]
    block = Window.partitionBy(*place)
    inside = block.orderBy("__turn", "__own", "__own2")
    here = F.struct("__turn", "__own", "__own2")
    rows = rows.withColumn("__again", F.lag(here).over(inside).eqNullSafe(here)).where("not __again")
    rows = rows.withColumn("__at", F.row_number().over(inside))
    counts = rows.groupBy(*place).agg(F.count("*").alias("__c"))
    counts = counts.select(*place, F.sum("__c").over(Window.partitionBy("__key")).alias("__total"), *_before("__c"))
    rows = rows.join(counts, place).withColumn("__n", F.col("__at") + F.col("b__c"))
    lane = lambda seed: F.pmod(F.xxhash64(F.lit(seed), "__n", "__own", "__own2"), F.lit(1 << LANE_BITS))
    upto = block.orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.select(*place, "__conv", "__n", "__total", *[F.sum(lane(i)).over(upto).alias(x) for i, x in enumerate(LANES)])
    sums = rows.groupBy(*place).agg(*[F.max(x).alias(x) for x in LANES]).select(*place, *_before(*LANES))
    return rows.join(sums, place).select("__key", "__conv", "__n", "__total", *[(F.col(x) + F.col("b" + x)).alias(x) for x in LANES])


def maximal_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """__key, n_turns and n_copies of every conversation that is no proper prefix of another.

    Of equal conversations the one of least id stays and n_copies tells their number.
    """
    prefixes = checkpointed(prefix_hashes(_turns(df, conv_col, turn_col, role_col, text_col)))
    key = ["__n", *LANES]
    least = F.min_by("__key", F.struct(F.col("__conv").isNull().alias("null"), F.col("__conv").alias("id")))
    full = prefixes.where("__n = __total").groupBy(*key).agg(least.alias("__key"), F.count("*").alias("n_copies"))
    longer = prefixes.where("__n < __total").select(*key).distinct()
    return full.join(longer, key, "left_anti").select("__key", F.col("__n").cast("long").alias("n_turns"), "n_copies")


def collapse_and_render(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per maximal conversation: its id, n_turns, n_copies and the rendered chat.

    Null roles and texts render as empty, a null turn comes first, rows of null conversation id are
    one conversation; exact repeats of a turn are rendered once. Texts are rendered whole, however
    long. Further columns aren't read and an empty table gives an empty table. A conversation is one
    value, so its turns meet in one task, but only those of one conversation that stays.
    """
    kept = maximal_conversations(df, conv_col, turn_col, role_col, text_col)
    rows = _turns(df, conv_col, turn_col, role_col, text_col).join(kept, "__key")
    ordered = F.array_sort(
        F.collect_set(F.struct("__turn", F.xxhash64("__role", "__text").alias("a"), F.xxhash64("__text", "__role", F.lit(7)).alias("b"), "__role", "__text"))
    )
    grouped = rows.groupBy("__key", "n_turns", "n_copies").agg(F.min("__conv").alias("__conv"), ordered.alias("__turns"))
    chat = F.array_join(F.transform("__turns", lambda t: render_turn(t["__role"], t["__text"])), "")
    return grouped.select(F.col("__conv").alias(conv_col), "n_turns", "n_copies", chat.alias("rendered"))


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(read_table(spark, sf_dir, "conversations"))


ORACLE_SQL = """
WITH turns AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos,
         '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown
  FROM turns
), prefixes AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS total,
         string_agg(shown, '') OVER (PARTITION BY conv_id ORDER BY pos) AS chat
  FROM placed
), longer AS (SELECT DISTINCT chat FROM prefixes WHERE pos < total)
SELECT min(conv_id) AS conv_id, CAST(total AS BIGINT) AS n_turns, count(*) AS n_copies, chat AS rendered
FROM prefixes
WHERE pos = total AND chat NOT IN (SELECT chat FROM longer)
GROUP BY total, chat
"""
