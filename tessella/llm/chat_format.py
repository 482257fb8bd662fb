"""Chat formatting by event sourcing.

A log has one row per event: conv_id, message_id, seq, kind, role, text. Events of a message are folded in order of
seq: "message" and "delta" append their text, "edit" puts its text in place of all before, "regenerate" empties it.
Messages of a conversation follow in order of their first seq (ties: role, text) and are rendered to one string:

    <s>[INST] user text [/INST]</s><s>[OUT] assistant text [/OUT]</s>     (SYS: system, ROLE:hex: any other role)

Control strings inside texts get a backslash after their first character, and lose it again on reading. Folding and
rendering go by ranges of seq first, so a long message or conversation is put together from pieces.

Defined results: null text, role or kind are empty; an unknown kind appends; rows of equal seq follow by kind, role
and text; a null conv_id is a conversation; an empty log gives no rows; other columns are ignored, whatever their names.
A conversation ends as one row, the string that was asked for, so its length is bounded by a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events or messages of so many consecutive numbers are put together first.
RANGE = 256
# Tags of the common roles.
TAGS = {"user": "INST", "assistant": "OUT", "system": "SYS"}
_CONTROL = r"(/?s>|/?(?:INST|OUT|SYS|ROLE:[0-9A-F]*)\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", "$1$2$3")


def _tag(role: Column) -> Column:
    out = F.concat(F.lit("ROLE:"), F.hex(F.encode(role, "UTF-8")))
    for name, tag in TAGS.items():
        out = F.when(role == name, tag).otherwise(out)
    return out


def _role(tag: Column) -> Column:
    out = F.decode(F.unhex(F.substr(tag, F.lit(6))), "UTF-8")
    for name, mark in TAGS.items():
        out = F.when(tag == mark, name).otherwise(out)
    return out


def fold_messages(events: DataFrame) -> DataFrame:
    """conv_id, message_id, seq (the first), role (the last that isn't empty), text."""
    e = events.select(
        "conv_id", "message_id", F.col("seq").cast("long").alias("seq"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("kind", "role", "text")],
    )
    tail = "slice({0}, greatest(1, coalesce(array_max(transform({0}, (x, i) -> if({1}, i + 1, 0))), 1)), size({0}))"
    part = e.groupBy("conv_id", "message_id", F.expr(f"seq div {RANGE}").alias("_range")).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("a"))
    part = part.select(
        "conv_id", "message_id", "_range", F.expr("a[0].seq").alias("seq"), F.expr("exists(a, x -> x.kind in ('edit', 'regenerate'))").alias("reset"),
        F.expr("filter(a, x -> x.role != '')").alias("roles"), F.expr(tail.format("a", "x.kind in ('edit', 'regenerate')")).alias("t"),
    ).withColumns({"role": F.expr("coalesce(try_element_at(roles, -1).role, '')"), "text": F.expr("array_join(transform(t, x -> if(x.kind = 'regenerate', '', x.text)), '')")})
    whole = part.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list(F.struct("_range", "seq", "reset", "role", "text"))).alias("a"))
    return whole.select(
        "conv_id", "message_id", F.expr("a[0].seq").alias("seq"), F.expr("coalesce(try_element_at(filter(a, x -> x.role != ''), -1).role, '')").alias("role"),
        F.expr(f"array_join(transform({tail.format('a', 'x.reset')}, x -> x.text), '')").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_spans: the code points [start, end) of the escaped assistant texts."""
    tag = _tag(F.col("role"))
    m = messages.select("conv_id", "seq", "role", "text", tag.alias("tag"), escape(F.col("text")).alias("esc")).withColumns({
        "turn": F.concat(F.lit("<s>["), F.col("tag"), F.lit("] "), F.col("esc"), F.lit(" [/"), F.col("tag"), F.lit("]</s>")),
        "before": F.length("tag") + 6,
        "loss": F.when(F.col("role") == "assistant", F.length("esc")),
    })
    part = m.groupBy("conv_id", F.expr(f"seq div {RANGE}").alias("_range")).agg(F.array_sort(F.collect_list(F.struct("seq", "role", "text", "turn", "before", "loss"))).alias("a"))
    part = part.select("conv_id", "_range", F.expr("array_join(transform(a, x -> x.turn), '')").alias("s"), F.expr("transform(a, x -> struct(length(x.turn) as n, x.before as before, x.loss as loss))").alias("marks"))
    whole = part.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_range", "s", "marks"))).alias("a"))
    spans = """aggregate(flatten(transform(a, x -> x.marks)), struct(0L as at, cast(array() as array<struct<start: bigint, end: bigint>>) as spans),
        (s, x) -> struct(s.at + x.n as at, if(x.loss is null, s.spans, array_append(s.spans, struct(s.at + x.before as start, s.at + x.before + x.loss as end))) as spans), s -> s.spans)"""
    return whole.select("conv_id", F.expr("array_join(transform(a, x -> x.s), '')").alias("formatted"), F.expr(spans).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """The rendered conversations with turns: array of role and text, parsed from the string alone."""
    def turn(x: Column) -> Column:
        tag = F.substring_index(F.substr(x, F.lit(2)), "]", 1)
        return F.struct(_role(tag).alias("role"), unescape(F.substr(x, F.length(tag) + 4, F.length(x) - 2 * F.length(tag) - 11)).alias("text"))

    return formatted.withColumn("turns", F.transform(F.expr("slice(split(formatted, '<s>', -1), 2, greatest(size(split(formatted, '<s>', -1)) - 1, 0))"), turn))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The texts that the spans cut out of the rendered string, each unescaped, one after the other."""
    return F.array_join(F.transform(spans, lambda x: unescape(F.substr(formatted, (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")))), "")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold_messages(events))


def as_log(rows: DataFrame) -> DataFrame:
    """A log whose fold gives these messages (conv_id, turn, role, text): by the hash of conv_id and turn a message comes
    whole, as two deltas, as a draft that is edited, or as a draft that is regenerated and streamed again."""
    half = F.expr("length(text) div 2")
    first, rest = F.substr("text", F.lit(1), half), F.substr("text", half + 1)
    event = lambda n, kind, text: F.struct((F.col("turn") * 4 + n).alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
    draft, way = F.concat(F.lit("draft: "), F.reverse("text")), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    log = (
        F.when(way == 0, F.array(event(0, "message", F.col("text")))).when(way == 1, F.array(event(0, "delta", first), event(1, "delta", rest)))
        .when(way == 2, F.array(event(0, "message", draft), event(1, "edit", F.col("text")))).otherwise(F.array(event(0, "delta", draft), event(1, "regenerate", F.lit("")), event(2, "delta", first), event(3, "delta", rest)))
    )
    named = rows.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("message_id"))
    return named.select("conv_id", "message_id", "role", F.explode(log).alias("e")).select("conv_id", "message_id", "e.seq", "e.kind", "role", "e.text")


def op2_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.sql("SELECT cast(-1 AS bigint) conv_id, cast(turn AS bigint) turn, role, '</s>[INST] ok [/INST]' text FROM VALUES (0, 'user'), (1, 'assistant') AS v(turn, role)")
    back = read_back(format_chats(as_log(rows.unionByName(more)))).withColumn("loss", under_mask(F.col("formatted"), F.col("loss_spans")))
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.expr("array_join(transform(turns, x -> concat(x.role, '\n', x.text, '\n')), '')"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)
), t AS (
  SELECT *, length(CASE role WHEN 'user' THEN 'INST' WHEN 'assistant' THEN 'OUT' WHEN 'system' THEN 'SYS' ELSE 'ROLE:' || hex(role) END) AS k,
    length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:INST|OUT|SYS|ROLE:[0-9A-F]*)\])', '\1\\\2\3', 'g')) AS n FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n + 2 * k + 14)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""
