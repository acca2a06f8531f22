"""Chat formatting, in DataFrame functions only: a state machine over roles and a declarative template."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What opens and closes a turn of each role, and whether its text is trained on. ``other`` serves
#: roles that have no entry; it carries the role's name. Every opening and closing part holds a
#: control string, so that no escaped text can look like one.
TEMPLATE = {
    "roles": {
        "system": {"open": "<<SYS>>\n", "close": "\n<</SYS>>\n", "loss": False},
        "user": {"open": "[INST] ", "close": " [/INST]", "loss": False},
        "assistant": {"open": "<s>", "close": "</s>", "loss": True},
    },
    "other": {"open": "[ROLE]", "named": "[/ROLE]", "close": "[/TURN]", "loss": False},
    "control": ["<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[/TURN]"],
}
#: State and role give the next state; what is not listed is an error. ``accept`` lists final states.
MACHINE = {
    "next": {
        ("start", "system"): "system",
        ("start", "user"): "user",
        ("system", "user"): "user",
        ("user", "assistant"): "assistant",
        ("assistant", "user"): "user",
    },
    "accept": ["user", "assistant"],
}


def escape(text: Column, control: list[str]) -> Column:
    """Double every backslash, then put one behind the first character of every control string."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    heads: dict[str, list[str]] = {}
    for word in control:
        heads.setdefault(word[0], []).append(re.escape(word[1:]))
    pattern = "|".join(f"{re.escape(head)}(?={'|'.join(tails)})" for head, tails in heads.items())
    return F.regexp_replace(doubled, f"({pattern})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def format_chats(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    template: dict = TEMPLATE,
    machine: dict = MACHINE,
) -> DataFrame:
    """One row per conversation: conv_id, valid, segments array of (text, loss), formatted.

    Turns stand in the order of their number, then role, then text, so ties and repeated rows
    have one order; null numbers come first. Null texts and roles count as empty. A conversation
    whose roles break the state machine is formatted all the same and has ``valid`` false. Each
    turn gives three segments: what opens it, its escaped text, what closes it; only texts of
    roles with ``loss`` carry the flag. ``formatted`` is all segments, joined. A conversation is one
    training example and is held by one task; an empty table gives an empty result.
    """
    roles, other, control = template["roles"], template["other"], template["control"]
    turns = F.array_sort(
        F.collect_list(
            F.struct(
                F.col(turn_col).cast("bigint").alias("turn"),
                F.coalesce(F.col(role_col), F.lit("")).alias("role"),
                F.coalesce(F.col(text_col), F.lit("")).alias("text"),
            )
        )
    )
    known = F.array(*[F.lit(x) for x in roles])
    opens, closes = (_literal_map({k: v[part] for k, v in roles.items()}) for part in ("open", "close"))
    losses = F.array(*[F.lit(k) for k, v in roles.items() if v["loss"]]).cast("array<string>")

    def opened(role: Column) -> Column:
        named = F.concat(F.lit(other["open"]), escape(role, control), F.lit(other["named"]))
        return F.when(F.array_contains(known, role), opens[role]).otherwise(named)

    def closed(role: Column) -> Column:
        return F.coalesce(closes[role], F.lit(other["close"]))

    def segments(turn: Column) -> Column:
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(opened(turn.role), F.lit(False)),
            part(escape(turn.text, control), F.array_contains(losses, turn.role)),
            part(closed(turn.role), F.lit(False)),
        )

    steps = _literal_map({f"{state}>{role}": to for (state, role), to in machine["next"].items()})
    last = F.aggregate(
        "turns",
        F.lit("start"),
        lambda state, turn: F.coalesce(steps[F.concat(state, F.lit(">"), turn.role)], F.lit("error")),
    )
    return (
        rows.groupBy(F.col(conv_col).alias("conv_id"))
        .agg(turns.alias("turns"))
        .select(
            "conv_id",
            last.isin(*machine["accept"]).alias("valid"),
            F.flatten(F.transform("turns", segments)).alias("segments"),
        )
        .withColumn("formatted", F.array_join(F.transform("segments", lambda s: s.text), ""))
    )


def read_chats(formatted: Column, template: dict = TEMPLATE) -> Column:
    """The turns of a formatted conversation, as an array of (role, text)."""
    roles, other = template["roles"], template["other"]
    java = lambda s: "".join("\\" + c if c in r"\[](){}.*+?^$|/<>" and c not in "/<>" else c for c in s)
    forms = [f"{java(v['open'])}.*?{java(v['close'])}" for v in [*roles.values(), other]]
    found = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(forms)), F.lit(0))

    def parse(turn: Column) -> Column:
        head = F.substring_index(turn, other["named"], 1)
        out = F.struct(
            unescape(F.substring(head, len(other["open"]) + 1, 2**31 - 1)).alias("role"),
            unescape(
                F.substr(
                    turn,
                    F.length(head) + len(other["named"]) + 1,
                    F.length(turn) - F.length(head) - len(other["named"]) - len(other["close"]),
                )
            ).alias("text"),
        )
        for role, v in roles.items():
            n = len(v["open"]) + len(v["close"])
            mine = F.struct(
                F.lit(role).alias("role"),
                unescape(F.substr(turn, F.lit(len(v["open"]) + 1), F.length(turn) - n)).alias("text"),
            )
            out = F.when(F.startswith(turn, F.lit(v["open"])), mine).otherwise(out)
        return out

    return F.transform(found, parse)


def trained_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
