"""Chat formatting in Spark expressions: conversations to one text each, and back.

The turns of a conversation are collected as structs and sorted; adjacent turns of one
role are merged to a block by slicing the array, and blocks are concatenated:

    <s>[TURN]role[TEXT]text[NEXT]text</s><s>[TURN]...

Control strings that stand in a text or a role get a backslash after their first
character, and one more where they have some already, so reading back is exact. The loss
mask are the spans, in code points, of the texts of one role.

A null text or role counts as empty. Turns are in order of turn (null first), then role,
then text. A null conv_id is a conversation of its own. A conversation's text is one
value, so its turns have to fit a task, as the result itself does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, running

BEGIN, TEXT, NEXT, END = "<s>[TURN]", "[TEXT]", "[NEXT]", "</s>"
#: What texts may not hold as it is: this template's controls and those of its relatives.
_CONTROLS = r"/?s>|/?INST\]|/?SYS\]|TURN\]|TEXT\]|NEXT\]"
_PLAIN = rf"([<\[])(\\*)({_CONTROLS})"
_ESCAPED = rf"([<\[])\\(\\*)({_CONTROLS})"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def _split(text: Column, mark: str) -> Column:
    return F.split(text, mark.replace("[", r"\[").replace("]", r"\]"), -1)


def _loss_spans(blocks: Column, loss_role: str) -> Column:
    """(start, end, turn) of the texts of a role, from the sizes of the turns' pieces."""

    def pieces(b: Column) -> Column:
        last = F.size(b["texts"]) - 1
        lead = lambda i: F.when(i == 0, F.length(b["role"]) + len(BEGIN) + len(TEXT)).otherwise(len(NEXT))
        tail = lambda i: F.when(i == last, len(END)).otherwise(0)
        return F.transform(b["texts"], lambda t, i: F.struct(lead(i).alias("lead"), F.length(t).alias("size"), tail(i).alias("tail"), (b["role"] == loss_role).alias("counts")))

    def spans(parts: Column, starts: Column) -> Column:
        start = lambda p, i: (F.get(starts, i) + p["lead"]).cast("int")
        each = F.transform(parts, lambda p, i: F.struct(start(p, i).alias("start"), (start(p, i) + p["size"]).alias("end"), i.alias("turn"), p["counts"].alias("counts")))
        return F.transform(F.filter(each, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["turn"].alias("turn")))

    sizes = lambda parts: F.transform(parts, lambda p: p["lead"] + p["size"] + p["tail"])
    return let(F.flatten(F.transform(blocks, pieces)), lambda parts: let(running(sizes(parts)), lambda starts: spans(parts, starts)))


def _blocks(turns: Column) -> Column:
    """(role, texts), escaped, of runs of adjacent turns of one role."""

    def merged(each: Column, starts: Column) -> Column:
        runs = F.transform(starts, lambda s, k: F.slice(each, s + 1, F.coalesce(F.get(starts, k + 1), F.size(each)) - s))
        return F.transform(runs, lambda r: F.struct(escaped(F.get(r, F.lit(0))["role"]).alias("role"), F.transform(r, lambda t: escaped(t["text"])).alias("texts")))

    def begins(each: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(each) - 1), lambda i: (i == 0) | (F.get(each, i)["role"] != F.get(each, i - 1)["role"]))

    return let(turns, lambda each: let(begins(each), lambda starts: merged(each, starts)))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", loss_role: str = LOSS_ROLE) -> DataFrame:
    """(conv, formatted, loss_spans) for each conversation; other columns are left out.

    loss_spans: (start, end, turn) of each text of ``loss_role``, in code points of the
    formatted text, and which of the conversation's turns it is.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(conv).alias("conv")).agg(F.array_sort(F.collect_list(one)).alias("turns"))

    def formatted(blocks: Column) -> Column:
        joined = F.transform(blocks, lambda b: F.concat(F.lit(BEGIN), b["role"], F.lit(TEXT), F.array_join(b["texts"], NEXT), F.lit(END)))
        return F.struct(F.array_join(joined, "").alias("formatted"), _loss_spans(blocks, loss_role).alias("loss_spans"))

    done = rows.select("conv", let(_blocks(F.col("turns")), formatted).alias("done"))
    return done.select(F.col("conv").alias(conv), "done.formatted", "done.loss_spans")


def read_back(formatted: Column) -> Column:
    """The turns, an array of (role, text), of a formatted conversation."""
    blocks = F.filter(_split(formatted, BEGIN), lambda b, k: k > 0)

    def turns(block: Column) -> Column:
        body = F.substr(block, F.lit(1), F.length(block) - len(END))
        head = unescaped(F.substring_index(body, TEXT, 1))
        texts = _split(F.get(_split(body, TEXT), F.lit(1)), NEXT)
        return F.transform(texts, lambda t: F.struct(head.alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, spans: Column) -> Column:
    """The unescaped texts under the loss mask; each is cut from its own turn's piece of the formatted text."""
    pieces = F.split(formatted, r"(?=<s>\[TURN\]|\[NEXT\])", -1)

    def cut_out(parts: Column, starts: Column) -> Column:
        return F.transform(spans, lambda s: unescaped(F.substr(F.get(parts, s["turn"]), (s["start"] - F.get(starts, s["turn"]) + 1).cast("int"), s["end"] - s["start"])))

    return let(pieces, lambda parts: let(running(F.transform(parts, F.length)), lambda starts: cut_out(parts, starts)))


def digests(conversations: DataFrame) -> DataFrame:
    """Figures of all conversations and of conversation -1, read back from the formatted texts."""
    trap = "</s>[INST] ok [/INST]"
    more = conversations.sparkSession.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    done = format_conversations(conversations.select("conv_id", "turn", "role", "text").unionByName(more))
    back = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), F.array_join(under_mask(F.col("formatted"), F.col("loss_spans")), "").alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def oracle() -> str:
    """The digests in DuckDB's SQL, from the rows themselves."""
    plain = _PLAIN.replace("'", "''")
    length = f"length(regexp_replace({{0}}, '{plain}', '\\1\\\\\\2\\3', 'g'))"
    return f"""WITH named AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
        placed AS (SELECT *, row_number() OVER w AS place, lag(role) OVER w AS prior FROM named WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
            CAST(coalesce(sum(length(text)) FILTER (WHERE role = '{LOSS_ROLE}'), 0) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = '{LOSS_ROLE}'), '')) AS loss_sha256,
            CAST(sum({length.format("text")} + CASE WHEN prior = role THEN {len(NEXT)} ELSE {len(BEGIN + TEXT + END)} + {length.format("role")} END) AS BIGINT) AS formatted_chars
        FROM placed GROUP BY conv_id"""
