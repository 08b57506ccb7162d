"""Chat formatting with the perspective of every participant, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from waymark.llm.spread import SALTS, shuffled, small_enough
from waymark.llm.store import materialize

#: Template of a message; the trained part is what follows the header of the assistant's own messages.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: Turns of a conversation over which a running sum goes at a time, and characters of a message's hash by which messages of one turn are parted.
SPAN, PARTED = 4096, 3


def _plain(c: Column) -> Column:
    """A text without marks of the template: they lose their bars."""
    return F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<$1>")


def _header(name: Column, speaker: Column) -> Column:
    """The header of a message; a name cannot end it: its backslashes and line breaks are written out and its marks lose their bars."""
    safe = F.regexp_replace(F.regexp_replace(F.regexp_replace(_plain(name), r"\\", r"\\\\"), "\n", r"\\n"), "\r", r"\\r")
    own = F.when(name == speaker, F.lit("assistant")).when(name == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), safe))
    return F.concat(F.lit(OPEN), own, F.lit("\n"))


def _with_speakers(messages: DataFrame, who: DataFrame, small: bool) -> DataFrame:
    """Every message beside every participant of its conversation; a conversation's messages are spread by salts where ``who`` is not broadcast."""
    same = F.col("conv_id").eqNullSafe(F.col("p_conv"))
    if small:
        return messages.join(F.broadcast(who), same).drop("p_conv")
    salted = messages.withColumn("_salt", F.pmod(F.xxhash64("turn", "key"), F.lit(SALTS)))
    copies = who.withColumn("p_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return shuffled(salted, copies, same & (F.col("_salt") == F.col("p_salt"))).drop("p_conv", "_salt", "p_salt")


def rotate(conversations: DataFrame) -> DataFrame:
    """Every dialogue as seen by every participant, one row per message and participant.

    ``conversations`` has conv_id, turn, role and text.  For each participant
    (a role other than ``system``; a null role is named ``unknown``) the whole
    dialogue is rendered with that speaker as the assistant and the others as
    named users.  Rows carry conv_id, speaker, turn, name, the rendered
    ``segment``, its ``start`` and ``stop`` in the rendering in characters, and
    ``train_from``: where the trained part (text and end mark of the
    assistant's own messages) starts, null in others' messages.  Messages go
    by turn (nulls last); those of one turn by the md5 of name and text.
    Repeated messages stay.  A null text renders as empty, marks of the template
    within a text or a name lose their bars, line breaks within a name are
    written out, a null conv_id is one dialogue, a dialogue of system messages
    only has no participant and no rows, and an empty table gives none.

    Repeated messages are counted first.  Running sums go over spans of turns,
    then over the turns of a span and hash prefixes of a turn, then within one
    of these, so that neither a very long dialogue nor a very full turn is
    gathered in one task.
    """
    name, body = F.coalesce("role", F.lit("unknown")), _plain(F.coalesce("text", F.lit("")))
    m = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), name.alias("name"), body.alias("body"))
    m = m.groupBy("conv_id", "turn", "name", "body").agg(F.count(F.lit(1)).alias("times"))
    m = materialize(m.withColumn("key", F.md5(F.concat("name", F.lit("\n"), "body"))), "messages")
    who = m.where("name <> 'system'").select(F.col("conv_id").alias("p_conv"), F.col("name").alias("speaker")).distinct()
    who = materialize(who, "participants")
    small = small_enough(who)
    place = ["conv_id", "speaker", "turn", "prefix"]
    prefix = F.substring("key", 1, PARTED)
    head = _header(F.col("name"), F.col("speaker"))
    long = F.length(head) + F.col("n") + len(CLOSE)
    narrow = m.select("conv_id", "turn", "name", "key", "times", F.length("body").cast("long").alias("n"))
    sums = _with_speakers(narrow, who, small).groupBy("conv_id", "speaker", "turn", prefix.alias("prefix")).agg(F.sum(long * F.col("times")).alias("n"))
    sums = materialize(sums.withColumn("span", F.floor(F.col("turn") / SPAN)), "turn-sums")
    spans = sums.groupBy(F.col("conv_id").alias("s_conv"), F.col("speaker").alias("s_speaker"), F.col("span").alias("s_span")).agg(F.sum("n").alias("span_n"))
    before = F.sum("span_n").over(Window.partitionBy("s_conv", "s_speaker").orderBy(F.col("s_span").asc_nulls_last())) - F.col("span_n")
    spans = spans.withColumn("span_before", before)
    inside = F.sum("n").over(Window.partitionBy("conv_id", "speaker", "span").orderBy(F.col("turn").asc_nulls_last(), "prefix")) - F.col("n")
    same_span = F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("speaker") == F.col("s_speaker")) & F.col("span").eqNullSafe(F.col("s_span"))
    starts = shuffled(sums.withColumn("inside", inside), spans, same_span).select(*[F.col(c).alias(f"o_{c}") for c in place], (F.col("span_before") + F.col("inside")).alias("before"))
    both = _with_speakers(m, who, small).withColumns({"prefix": prefix, "segment": F.concat(head, "body", F.lit(CLOSE)), "head": F.length(head)})
    both = both.withColumn("n", F.length("segment").cast("long"))
    within = F.sum(F.col("n") * F.col("times")).over(Window.partitionBy(*place).orderBy("key", "name", "body").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n") * F.col("times")
    same = [F.col(c).eqNullSafe(F.col(f"o_{c}")) for c in place]
    placed = shuffled(both.withColumn("within", within), starts, same).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    start = F.col("before") + F.col("within") + F.col("i") * F.col("n")
    placed = placed.select("conv_id", "speaker", "turn", "name", "segment", "head", start.alias("start"), (start + F.col("n")).alias("stop"))
    return placed.withColumn("train_from", F.when(F.col("name") == F.col("speaker"), F.col("start") + F.col("head"))).drop("head")


def render(conversations: DataFrame) -> DataFrame:
    """One row per conversation and participant: the whole rendering and its masks.

    For dialogues that fit in a row: ``text`` is the rendering, ``masks`` the
    array of (start, stop) character ranges that are trained on.  Nulls, repeats
    and empty tables are as in ``rotate``.
    """
    rows = rotate(conversations)
    parts = F.array_sort(F.collect_list(F.struct("start", "segment", "train_from", "stop")))
    joined = rows.groupBy("conv_id", "speaker").agg(parts.alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["train_from"].isNotNull()), lambda p: F.struct(p["train_from"].alias("start"), p["stop"].alias("stop")))
    return joined.select("conv_id", "speaker", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("text"), masks.alias("masks"))


def op9_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's view: see ``rotate``, nulls and repeats included; an empty table gives no rows."""
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = r"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS name,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\1>', 'g') AS body FROM conversations
), p AS (
  SELECT DISTINCT conv_id, name AS speaker FROM m WHERE name <> 'system'
), b AS (
  SELECT m.conv_id, speaker, turn, name, body, md5(name || chr(10) || body) AS key,
         replace(replace(replace(regexp_replace(name, '<\|(im_start|im_end)\|>', '<\1>', 'g'), '\', '\\'), chr(10), '\n'), chr(13), '\r') AS safe
  FROM m JOIN p ON m.conv_id IS NOT DISTINCT FROM p.conv_id
), h AS (
  SELECT *, '<|im_start|>' || CASE WHEN name = speaker THEN 'assistant' WHEN name = 'system' THEN 'system' ELSE 'user name=' || safe END || chr(10) AS head FROM b
), s AS (
  SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM h
), o AS (
  SELECT *, (sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, key, name, body ROWS UNBOUNDED PRECEDING))::BIGINT AS stop FROM s
)
SELECT conv_id, speaker, turn, name, segment, stop - length(segment) AS start, stop,
       CASE WHEN name = speaker THEN stop - length(segment) + length(head) END AS train_from
FROM o
"""
