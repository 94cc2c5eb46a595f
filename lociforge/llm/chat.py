"""Chat formatting with a grammar round trip, in DataFrame operations only.

Grammar of a rendered conversation:

    conversation := turn*
    turn   := '<<SYS>>' text '<</SYS>>'            role system
            | '[INST]' text '[/INST]'              role user
            | '<s>' text '</s>'                    role assistant
            | '[ROLE]' text '[SAYS]' text '[/ROLE]'  any other role, named first
    text   := characters without a control string, read with the entities
              '&lsqb;' for '[', '&lt;' for '<' and '&amp;' for '&'

Every turn is first rendered as it stands and parsed again; where the parser
does not give the same role and text back, its '&', '<' and '[' are escaped.
No control string can then be left, as each begins with '<' or '['.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[SAYS]", "[/ROLE]")
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))

_CONTROL = r"<<SYS>>|<</SYS>>|<s>|</s>|\[/?INST\]|\[/?ROLE\]|\[SAYS\]"
_CLOSE = r"(?<=<</SYS>>|</s>|\[/INST\]|\[/ROLE\])"


def escape(text: Column) -> Column:
    for plain, entity in ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescape(text: Column) -> Column:
    for plain, entity in reversed(ENTITIES):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def _render(role: Column, text: Column, escaped: bool) -> Column:
    body = escape(text) if escaped else text
    name = escape(role) if escaped else role
    out = F.concat(F.lit("[ROLE]"), name, F.lit("[SAYS]"), body, F.lit("[/ROLE]"))
    for known, (opening, closing) in MARKS.items():
        out = F.when(role == known, F.concat(F.lit(opening), body, F.lit(closing))).otherwise(out)
    return out


def _between(piece: Column, opening: str, closing: str) -> Column:
    return F.substring(piece, F.lit(len(opening) + 1), F.length(piece) - F.lit(len(opening) + len(closing)))


def parse(rendered: Column) -> Column:
    """The turns of a rendered text as array<struct<role, text>>; text is null in a turn that breaks the grammar."""
    pieces = F.filter(F.split(rendered, _CLOSE), lambda p: p != "")

    def turn(p: Column) -> Column:
        inner = _between(p, "[ROLE]", "[/ROLE]")
        cut = F.instr(inner, "[SAYS]")
        other = p.startswith("[ROLE]") & p.endswith("[/ROLE]") & (cut > 0)
        role = F.when(other, F.substring(inner, F.lit(1), cut - 1))
        body = F.when(other, F.substring(inner, cut + len("[SAYS]"), F.length(inner)))
        for known, (opening, closing) in MARKS.items():
            here = p.startswith(opening) & p.endswith(closing) & (F.length(p) >= len(opening) + len(closing))
            role, body = F.when(here, F.lit(known)).otherwise(role), F.when(here, _between(p, opening, closing)).otherwise(body)
        bad = body.rlike(_CONTROL) | role.rlike(_CONTROL)
        return F.struct(unescape(role).alias("role"), F.when(~bad, unescape(body)).alias("text"))

    return F.transform(pieces, turn)


def render_turn(role: Column, text: Column) -> Column:
    """A turn's rendering: as it stands if the parser reads it back, escaped otherwise."""
    raw = _render(role, text, False)
    read = parse(raw)
    same = (F.size(read) == 1) & read[0].role.eqNullSafe(role) & read[0].text.eqNullSafe(text)
    return F.when(same, raw).otherwise(_render(role, text, True))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss_spans, round_trip), a row a conversation.

    Rows stand by turn (null first), ties by role and text; repeated rows are
    turns of their own; null texts and roles are empty; rows without a
    conversation id form one conversation; an empty table gives no rows; other
    columns are left out.  loss_spans holds start (from 0) and length in code
    points of each assistant text inside `formatted`, as rendered.  round_trip
    tells whether the parser gives back all turns of the whole rendering.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("piece", render_turn(F.col("role"), F.col("text")))
    got = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "piece"))).alias("t"))
    got = got.withColumn("formatted", F.array_join(F.col("t.piece"), ""))
    opening, closing = (len(x) for x in MARKS["assistant"])
    ends = F.aggregate(
        F.col("t"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + F.length(x.piece)).alias("at"),
            F.when(
                x.role == "assistant",
                F.concat(acc.spans, F.array(F.struct((acc.at + opening).alias("start"), (F.length(x.piece) - (opening + closing)).alias("length")))),
            ).otherwise(acc.spans).alias("spans"),
        ),
    )
    plain = F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("text")))
    return got.select("conv_id", "formatted", ends.spans.alias("loss_spans"), parse(F.col("formatted")).eqNullSafe(plain).alias("round_trip"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars, round_trip): what the rendering and its loss mask hold, unescaped.

    A text that breaks the grammar is null in its turn; no rows give none.
    """
    text = F.col("formatted")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(text, s.start + 1, s.length))), "")
    return formatted.select("conv_id", parse(text).alias("turns"), loss.alias("loss_text"), F.length(text).cast("long").alias("formatted_chars"), "round_trip")
