"""Repair of conversations against all scripts of edits, tried one by one."""

import random
import re
import zlib
from hashlib import sha256
from itertools import product

import pytest
from pyspark.sql import functions as F

from twinsieve.llm import conversations as cv

#: Their only turn is dropped.
GONE = [(92, 0, "user", "Hi."), (112, 0, "user", "Ho.")]
SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def faults(turns):
    """(turn, role, text, fault) in order of turn."""
    from hashlib import md5

    seen, out = set(), []
    for t, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], md5(r[2].encode()).hexdigest())):
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((t, role, text, fault))
    return out


def brute(turns):
    """(cost, audit, repaired) by a search over all scripts with few insertions between turns."""
    best = None
    gaps = [("",), ("u",), ("a",), ("u", "a"), ("a", "u")]
    ways = [[("K",), ("R", "user"), ("R", "assistant"), ("D",)] if f not in ("blank", "duplicate") else [("D",)] for *_, f in turns]
    for inserted in product(gaps, repeat=len(turns) + 1):
        for edits in product(*ways):
            cost, audit, roles, lines = 0, "", "", []
            for k in range(len(turns) + 1):
                for r in inserted[k]:
                    if r:
                        name = {"u": "user", "a": "assistant"}[r]
                        cost, audit, roles = cost + 3, audit + "I", roles + r
                        lines.append(f"{name}:")
                if k < len(turns):
                    (_, role, text, fault), (letter, *new) = turns[k], edits[k]
                    audit += letter
                    cost += {"K": 0, "R": 3, "D": 4}[letter]
                    if letter != "D":
                        name = new[0] if new else role
                        cost += 3 * (fault == "truncated")
                        roles += name[:1] or "-"
                        lines.append(f"{name}:{text}")
            if GOOD.match(roles) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, "\n".join(lines))
    return best


def expected(turns):
    turns = faults(turns)
    numbers = [t[0] for t in turns if t[0] is not None]
    initials = [t[1][:1] for t in turns]
    count = lambda f: sum(t[3] == f for t in turns)
    cost, audit, text = brute(turns)
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    return (gaps, count("blank"), count("duplicate"), count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, text)


def random_conversations(seed, n):
    rng = random.Random(seed)
    out = {}
    for i in range(n):
        k = rng.randrange(1, 4)
        numbers = sorted(rng.choice([None, *range(6)]) or 0 for _ in range(k))
        out[i] = [(rng.choice([None, t]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Yes.", "No", "", " \n", "Why?  ", "Yes."])) for t in numbers]
    return out


def result(df):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired")
    return {r["conv_id"]: tuple(r[n] for n in names) for r in df.collect()}


@pytest.mark.parametrize("piece", [512, 1, 2])
def test_cheapest_of_all_scripts(spark, monkeypatch, piece):
    monkeypatch.setattr(cv, "PIECE", piece)
    talks = random_conversations(piece, 50)
    rows = [(i, *t) for i, turns in talks.items() for t in turns]
    assert result(cv.repair(spark.createDataFrame(rows, SCHEMA))) == {i: expected(t) for i, t in talks.items()}


def test_a_long_conversation_in_pieces_is_as_one(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["a.", "b", "", f"{t}."])) for t in range(1_500)]
    df = spark.createDataFrame(rows, SCHEMA)
    in_pieces = result(cv.repair(df))
    monkeypatch.setattr(cv, "PIECE", 10_000)
    assert in_pieces == result(cv.repair(df))
    assert len(in_pieces[7][6].replace("I", "")) == 1_500


def test_the_query_damages_as_told(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Fine. Yes!", "Well", "Is it?"])) for i in range(80) for t in range(3 if i < 50 else 1)] + GONE + [(99, 4, None, None), (None, None, "user", "Hm.")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    talks = {}
    for i, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if i is None else i}:{' ' if t is None else t}".encode()) % 20
        own, role, text = talks.setdefault(i, []), role or " ", text or " "
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            own += [(t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in cv.op11_conversations(spark, str(tmp_path)).collect()}
    want = {}
    for i, t in talks.items():
        *others, text = expected(t)
        want[i] = (*others, sha256(text.encode()).hexdigest())
    assert got == want
    assert any(not t for t in talks.values())


def test_edges_of_input(spark):
    clash = spark.createDataFrame([(1, 0, "user", "Hi.", 5, "x"), (1, 1, "assistant", "Yo.", 6, "y")], SCHEMA + ", cost long, turns string")
    assert result(cv.repair(clash)) == {1: (0, 0, 0, 0, 0, 0, "KK", "user:Hi.\nassistant:Yo.")}
    assert cv.repair(clash.where("1 = 0")).collect() == []
    long = spark.createDataFrame([(2, 0, "user", "x " * 300_000 + "end.")], SCHEMA)
    assert result(cv.repair(long))[2][5:7] == (3, "KI")
    blanks = spark.createDataFrame([(3, 0, "user", "x" + " " * 1_000_000 + "y."), (3, 1, "assistant", "y.\t\r\n\x0b\x0c "), (3, 2, "user", "z" + "\t \n" * 200_000)], SCHEMA)
    assert result(cv.repair(blanks))[3][:7] == (0, 0, 0, 1, 0, 4, "KKD")
    # a third of all rows are copies under one null conv_id, and turn numbers at the ends of their range do no harm
    many = spark.range(20_000).select(F.lit(None).cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    (row,) = result(cv.repair(many)).values()
    assert row[:6] == (0, 0, 19_999, 0, 19_999, 19_999 * 4 + 3) and row[6] == "K" + "D" * 19_999 + "I"
