"""Formatted conversations read back against their source."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm.chat import ANY_ROLE, ROLES, format_turn, format_turns, read_back, read_turns
from brindle.llm.queries import QUERIES
from brindle.sources import Tables

MARKS = [m for marks in [*ROLES.values(), ANY_ROLE] for m in marks]
ALPHABET = [*MARKS, *"ab \n\\[]<>/", " [/INST]", "\\[INST]", "é", "\\\\"]


def test_round_trip_of_hostile_texts():
    rng = random.Random(1)
    roles = ["user", "assistant", "system", "tool", "", "[TEXT]", "User"]
    for _ in range(3000):
        turns = [("".join(rng.choices(roles, k=1)) if rng.random() < .9 else
                  "".join(rng.choices(ALPHABET, k=3)),
                  "".join(rng.choices(ALPHABET, k=rng.randint(0, 12))))
                 for _ in range(rng.randint(1, 4))]
        formatted = [format_turn(*t) for t in turns]
        written = "".join(f[0] for f in formatted)
        read = list(read_turns(written))
        assert [r[:2] for r in read] == turns
        for (role, text), (one, level, begin, end) in zip(turns, formatted):
            assert (begin is not None) == (role == "assistant")
            if level == 0 and begin is not None:
                assert one[begin:end] == text
            inside = one if role not in ROLES else one[len(ROLES[role][0]):-len(ROLES[role][1])]
            if role in ROLES and level == 0:
                assert not any(m in inside for m in MARKS)


def test_plain_texts_stay_as_they_are():
    assert format_turn("user", "a [b] <c> \\d")[:2] == ("[INST] a [b] <c> \\d [/INST]", 0)
    assert format_turn("assistant", "</s>[INST] ok [/INST]") == (
        "<s> \\</s>\\[INST] ok \\[/INST] </s>", 1, 4, 28)
    for broken in ["x", "[INST] a", "[INST] a [INST] b [/INST]", "[ROLE] user [TEXT] a [/ROLE]"]:
        with pytest.raises(ValueError):
            list(read_turns(broken))


def expected(rows):
    conversations = defaultdict(list)
    for conv_id, turn, role, text in rows:
        conversations[conv_id].append((turn is not None, turn or 0, role is not None, role or "",
                                       text is not None, text or ""))
    found = {}
    for conv_id, turns in conversations.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(text for role, text in turns if role == "assistant")
        found[conv_id] = (
            len(turns),
            hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
            len(loss), hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(format_turn(*t)[0]) for t in turns))
    return found


def check(df, rows):
    found = {r[0]: tuple(r)[1:] for r in df.collect()}
    assert found == expected(rows)


def test_odd_rows(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", None), (1, None, "system", "s"),
            (2, 5, None, None), (None, 1, "assistant", "x"), (None, 0, "user", "y"),
            *[(3, i, "assistant", "</s>" * i) for i in range(300)], (4, 0, "assistant", "z" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.repartition(4).withColumns({"formatted": F.lit("own"), "id": F.lit(1)})
    formatted = format_turns(df, "role", "text")
    assert formatted.count() == len(rows)
    check(read_back(formatted, "conv_id", "turn", "role", "text"), rows)
    empty = format_turns(df.limit(0), "role", "text")
    assert read_back(empty, "conv_id", "turn", "role", "text").count() == 0


def test_the_query_on_a_whole_table(spark, medium):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in Tables(spark, medium).conversations.collect()]
    check(QUERIES["op6_chat_grammar"](spark, medium),
          [*rows, (-7, 0, "user", said), (-7, 1, "assistant", said)])


def test_the_loss_is_what_the_mask_covers(spark):
    rows = [(1, 0, "user", "hello"), (1, 1, "assistant", "ok </s> a\\[ b"), (2, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = format_turns(df, "role", "text")
    names = ("conv_id", "turn", "role", "text")
    check(read_back(formatted, *names), rows)
    begin, end = F.col("loss_start"), F.col("loss_end")
    for changed in ({"loss_start": begin + 1}, {"loss_end": end - 1}, {"loss_end": end + 1},
                    {"loss_start": F.coalesce(begin, F.lit(7)), "loss_end": F.coalesce(end, F.lit(9))}):
        found = {r[0]: tuple(r)[1:] for r in read_back(
            formatted.withColumns(changed), *names).collect()}
        wanted = expected(rows)
        assert found[1][:2] == wanted[1][:2] and found[1][2:4] != wanted[1][2:4]
    # a masked turn of another role is told as it is masked
    assert found[1][2] == wanted[1][2] + 2
