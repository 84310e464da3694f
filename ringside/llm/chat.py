r"""Chat formatting: a role machine, a declarative template, segments with loss flags.

A template says how each role's text is opened and closed, which roles carry loss and which role may follow which.
Other roles use the template's general form, which also carries the role's name. Control strings inside a text get a
backslash after their first character, and backslashes are doubled first, so the text can be read back exactly: after
escaping, every control string left in the output is a mark of the template.

Turns are ordered by turn, then role, then text (repeated rows stay). Null roles and texts are empty; a null conv_id
is a conversation of its own. An empty table gives an empty result. A conversation is one value of the result and one
digest covers all of its text, so its turns meet in one row.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    roles: dict[str, tuple[str, str]]  # role: what opens and what closes its text
    general: tuple[str, str, str]  # opens the role, opens the text, closes the text
    loss_roles: tuple[str, ...]
    moves: dict[tuple[str, str], str]  # (state, role): next state; anything else is an error
    start: str = "start"
    accepted: tuple[str, ...] = ("answered",)
    error: str = "error"
    controls: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        marks = [m for pair in self.roles.values() for m in pair] + list(self.general)
        object.__setattr__(self, "controls", tuple(dict.fromkeys(marks)))


INSTRUCT = Template(
    roles={"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")},
    general=("<<ROLE>>", "<</ROLE>>", "<<END>>"),
    loss_roles=("assistant",),
    moves={
        ("start", "system"): "briefed",
        ("start", "user"): "asked",
        ("briefed", "user"): "asked",
        ("asked", "assistant"): "answered",
        ("answered", "user"): "asked",
    },
)


def escape(text: Column, template: Template) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in template.controls:
        text = F.replace(text, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return text


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _literal(marks: list[str]) -> str:
    return "|".join("".join(f"\\{c}" if c in "[]" else c for c in m) for m in marks)


def format_chats(chats: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row a conversation: segments (text, loss), formatted text, valid, and the first turn out of order.

    ``error_at`` is the place (from 0) of the first turn that the machine doesn't accept, the number of turns if only
    the end is missing, or null.
    """
    empty = F.lit("")
    turns = chats.select(
        "conv_id", F.struct("turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text")).alias("t")
    )
    one = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    moves = F.create_map(*[F.lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])

    def step(seen: Column, turn: Column) -> Column:
        to = F.coalesce(F.element_at(moves, F.concat(seen["state"], F.lit("\n"), turn["role"])), F.lit(template.error))
        at = F.when(seen["error_at"].isNull() & (to == template.error), seen["n"]).otherwise(seen["error_at"])
        return F.struct(to.alias("state"), (seen["n"] + 1).alias("n"), at.alias("error_at"))

    begin = F.struct(F.lit(template.start).alias("state"), F.lit(0).alias("n"), F.lit(None).cast("int").alias("error_at"))

    def segments(turn: Column) -> Column:
        general = F.concat(F.lit(template.general[0]), escape(turn["role"], template), F.lit(template.general[1]))
        opens, closes = general, F.lit(template.general[2])
        for role, (a, b) in template.roles.items():
            opens = F.when(turn["role"] == role, F.lit(a)).otherwise(opens)
            closes = F.when(turn["role"] == role, F.lit(b)).otherwise(closes)
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(part(opens, F.lit(False)), part(escape(turn["text"], template), turn["role"].isin(*template.loss_roles)), part(closes, F.lit(False)))

    return (
        one.withColumn("end", F.aggregate("turns", begin, step))
        .withColumn("segments", F.flatten(F.transform("turns", segments)))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            "segments",
            F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
            (F.col("end.error_at").isNull() & F.col("end.state").isin(*template.accepted)).alias("valid"),
            F.when(F.col("end.error_at").isNotNull(), F.col("end.error_at"))
            .when(~F.col("end.state").isin(*template.accepted), F.col("end.n"))
            .alias("error_at"),
        )
    )


def read_back(formatted: Column, template: Template = INSTRUCT) -> Column:
    """The turns (role, text) that a formatted text holds."""
    opens = [a for a, _ in template.roles.values()] + [template.general[0]]
    closes = [b for _, b in template.roles.values()] + [template.general[2]]
    pattern = F.lit(f"(?s)({_literal(opens)})(.*?)({_literal(closes)})")
    mark, body = (F.regexp_extract_all(formatted, pattern, F.lit(k)) for k in (1, 2))

    def turn(mark: Column, body: Column) -> Column:
        named = F.split(body, template.general[1], 2)
        role, text = named[0], F.try_element_at(named, F.lit(2))
        for name, (a, _) in template.roles.items():
            role = F.when(mark == a, F.lit(name)).otherwise(role)
        text = F.when(mark == template.general[0], text).otherwise(body)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.zip_with(mark, body, turn)


def op2_chat(chats: DataFrame) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = chats.sparkSession.sql(
        f"select * from values (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') as t(conv_id, turn, role, text)"
    )
    done = format_chats(chats.select("conv_id", "turn", "role", "text").unionByName(extra))
    nl = F.lit("\n")
    told = F.transform(read_back(F.col("formatted")), lambda t: F.concat(t["role"], nl, t["text"], nl))
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return (
        done.withColumn("told", told)
        .withColumn("loss_text", F.array_join(loss, ""))
        .select(
            "conv_id",
            F.size("told").cast("long").alias("n_turns"),
            F.sha2(F.array_join("told", ""), 256).alias("turns_sha256"),
            F.char_length("loss_text").cast("long").alias("loss_chars"),
            F.sha2("loss_text", 256).alias("loss_sha256"),
            F.char_length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )


def op2_sql() -> str:
    said = "</s>[INST] ok [/INST]"
    escaped = "replace(text, '\\', '\\\\')"
    for c in INSTRUCT.controls:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    role = escaped.replace("replace(text,", "replace(role,")
    known = " ".join(f"when '{r}' then {len(a) + len(b)}" for r, (a, b) in INSTRUCT.roles.items())
    general = sum(map(len, INSTRUCT.general))
    order = "order by turn nulls first, role, text"
    moves = " ".join(f"when before = '{a}' and role = '{b}' then true" for a, b in (("", "system"), ("", "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")))
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{said}' union all select -1, 1, 'assistant', '{said}'
), m as (
  select *, lag(role, 1, '') over (partition by conv_id {order}) as before,
    row_number() over (partition by conv_id {order}) as k,
    count(*) over (partition by conv_id) as n
  from t
), f as (
  select *, case {moves} else false end and (k < n or role = 'assistant') as good,
    length({escaped}) + case role {known} else {general} + length({role}) end as chars
  from m
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars,
  bool_and(good) as valid
from f group by conv_id
"""
