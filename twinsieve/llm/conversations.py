"""Repair of the structure of conversations: the cheapest edits that make roles alternate, by a fold in Spark SQL.

A repaired conversation has roles whose initials read `(s?(ua)+)?`: a system turn or none, then pairs of user and assistant
turns, or nothing at all.  Edits: K keeps a turn (cost 0), R gives it the role user or assistant (3), D deletes it (4;
blank and duplicate turns must go), I inserts a turn of empty text (3); a truncated turn that stays costs 3 more.

1. Faults.  Windows over a conversation flag repeated turns and adjacent roles that do not fit; the first fault counts.
2. Fold.  The sorted turns of a conversation are folded by `aggregate`, which carries four structs (cost, audit), one for each
   state that the roles so far can leave: nothing, a system turn, a user turn, an assistant turn.  The cheapest edits are
   the native `least` of structs: of equal costs the audit that is least in ASCII order.  Two audits of one cost, state
   and turns are never the beginning of one another (the longer one would have more insertions and cost more), so what is
   least now stays least whatever follows.  The state tells which role an insertion or a new role has; inside the fold J and
   S stand for the I and R that give an assistant, which changes no comparison.
3. Long conversations are folded in pieces of PIECE turns, each from all four states, and the pieces are folded then, so an
   audit is not copied once a turn.

Everything is native: one shuffle of the turns, by conversation.  A conversation's repaired text is one value in the result,
so its turns come together in a task; turns that must go leave their text behind before that, so copies and blanks weigh
little.  Nothing else is bounded by less than a conversation, whose repaired text must stay below Spark's 2 GB for a value.

Turns are in order of turn (nulls first), role, md5 of the text.  Null roles and texts are one space (a role that fits nowhere,
a blank text).  Null conv_ids are one conversation.  Repeated rows are duplicates.  An empty table gives an empty result, and
extra columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .sql import CRC_TABLE, crc32_sql

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: More than any script of edits costs.
NEVER = 1 << 60
PIECE = 512
NOT_BLANK = r"[^\x20\x09-\x0D]"
STATES = ("none", "system", "user", "assistant")


def _best(*ways: Column) -> Column:
    return F.least(*ways) if len(ways) > 1 else ways[0]


def _way(state: Column, cost, letters) -> Column:
    """The state's script, `letters` longer."""
    letters = F.lit(letters) if isinstance(letters, str) else letters
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letters).alias("audit"))


def _if(condition: Column, way: Column) -> Column:
    return F.struct(F.when(condition, way["cost"]).otherwise(F.lit(NEVER)).alias("cost"), F.when(condition, way["audit"]).otherwise(F.lit("")).alias("audit"))


def _inserted(at: Column) -> tuple[Column, Column]:
    """The states user and assistant, with insertions allowed.  More than two of them in a row lead back to a state."""
    user = _best(at["user"], *(_way(at[s], INSERT, "I") for s in ("none", "system", "assistant")))
    assistant = _best(at["assistant"], _way(at["user"], INSERT, "J"), *(_way(at[s], 2 * INSERT, "IJ") for s in ("none", "system")))
    return user, assistant


def _step(at: Column, turn: Column) -> Column:
    """The four states behind one more turn."""
    user, assistant = _inserted(at)
    cut = F.when(turn["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0))
    must_go = turn["fault"].isin("blank", "duplicate")
    stays = ~must_go
    is_role = lambda initial: turn["initial"] == initial
    edit = lambda initial, new: (F.when(is_role(initial), F.lit(KEEP)).otherwise(F.lit(REROLE)) + cut, F.when(is_role(initial), F.lit("K")).otherwise(F.lit(new)))
    as_user, as_assistant = edit("u", "R"), edit("a", "S")
    return F.struct(
        _way(at["none"], DELETE, "D").alias("none"),
        _best(_way(at["system"], DELETE, "D"), _if(stays & is_role("s"), _way(at["none"], cut + KEEP, "K"))).alias("system"),
        _best(_way(user, DELETE, "D"), *(_if(stays, _way(s, *as_user)) for s in (at["none"], at["system"], assistant))).alias("user"),
        _best(_way(assistant, DELETE, "D"), _if(stays, _way(user, *as_assistant))).alias("assistant"),
    )


def _start(state: str) -> Column:
    """A conversation of which nothing is read, that stands at `state`."""
    return F.struct(*(F.struct(F.lit(0 if s == state else NEVER).cast("long").alias("cost"), F.lit("").alias("audit")).alias(s) for s in STATES))


def _joined(at: Column, piece: Column) -> Column:
    """The four states behind a piece, of which `piece` tells them for each state in front of it."""
    behind = lambda s: _best(*(_if(piece[f"from_{f}"][s]["cost"] < NEVER, _way(at[f], piece[f"from_{f}"][s]["cost"], piece[f"from_{f}"][s]["audit"])) for f in STATES))
    return F.struct(*(behind(s).alias(s) for s in STATES))


def cheapest(turns: Column) -> Column:
    """(cost, audit) of the cheapest edits of an array of turns (initial, fault), with J and S for I and R that give an assistant."""
    whole = F.aggregate(turns, _start("none"), _step)
    pieces = F.sequence(F.lit(0), F.ceil(F.size(turns) / PIECE).cast("int") - 1)
    folded = F.transform(
        pieces, lambda k: F.struct(*(F.aggregate(F.slice(turns, k * PIECE + 1, F.lit(PIECE)), _start(s), _step).alias(f"from_{s}") for s in STATES))
    )
    long = F.aggregate(folded, _start("none"), _joined)
    # what the fold leaves is looked at through an array of one, so that it is made once
    end = F.transform(F.array(F.when(F.size(turns) > PIECE, long).otherwise(whole)), lambda at: F.least(at["none"], _inserted(at)[1]))
    return F.get(end, F.lit(0))


def repaired_text(turns: Column, audit: Column) -> Column:
    """`role:text` of the turns (role, text) that the edits leave, joined by newlines."""
    edits = F.regexp_extract_all(audit, F.lit("[IJ]*[KRSD]|[IJ]+$"), F.lit(0))
    inserted = lambda e: F.replace(F.replace(F.regexp_replace(e, "[KRSD]", ""), F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))

    def piece(e: Column, i: Column) -> Column:
        turn, letter = F.get(turns, i), F.right(e, F.lit(1))
        role = F.when(letter == "K", turn["role"]).when(letter == "R", "user").when(letter == "S", "assistant")
        return F.concat(inserted(e), F.coalesce(F.concat(role, F.lit(":"), turn["text"], F.lit("\n")), F.lit("")))

    lines = F.array_join(F.transform(edits, piece), "")
    return F.left(lines, F.length(lines) - 1)


def repair(rows: DataFrame, present: Column | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, gaps (turn numbers that are missing), blank, duplicate, truncated (turns whose first fault that is), illegal
    (neighbours that do not fit), cost, audit and repaired of every conversation of rows.  Rows for which `present` does not hold
    are no turns, but their conversation is told of."""
    c = F.col
    present = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    turns = rows.select(
        c(conv_id).alias("conv_id"), c(turn).cast("long").alias("turn"), F.coalesce(c(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(c(text).cast("string"), F.lit(" ")).alias("text"), present.alias("present"),
    )
    turns = turns.withColumn("digest", F.md5("text")).withColumn("text", F.when(c("present"), c("text"))).repartition("conv_id")
    order = [c("turn").asc_nulls_first(), c("role"), c("digest")]
    along = W.partitionBy("conv_id", "present").orderBy(*order)
    same = W.partitionBy("conv_id", "present", "role", "digest").orderBy(c("turn").asc_nulls_first())
    initial = F.left("role", F.lit(1))
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    fault = F.when(~c("text").rlike(NOT_BLANK), "blank").when(c("again"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    flagged = turns.withColumn("initial", initial).withColumn("before", F.lag("initial").over(along)).withColumn("again", F.row_number().over(same) > 1)
    flagged = flagged.withColumn("fault", fault).withColumn("illegal", ~F.concat("before", "initial").isin("su", "ua", "au"))
    kept_text = F.when(c("fault").isin("", "truncated"), c("text"))
    one = F.struct("turn", "role", "digest", "again", "initial", "fault", kept_text.alias("text"))
    times = lambda which: F.count(F.when(c("present") & which, 1))
    found = flagged.groupBy("conv_id").agg(
        *(times(c("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), times(c("illegal")).alias("illegal"),
        F.min(F.when(c("present"), c("turn"))).alias("low"), F.max(F.when(c("present"), c("turn"))).alias("high"),
        F.sort_array(F.collect_list(F.when(c("present"), one))).alias("turns"),
    )
    numbers = F.size(F.array_distinct(F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())))
    gaps = F.coalesce(c("high") - c("low") + 1 - numbers, F.lit(0)).cast("long")
    edits = found.withColumn("gaps", gaps).withColumn("best", cheapest(c("turns")))
    return edits.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", c("best.cost").alias("cost"),
        F.translate("best.audit", "JS", "IR").alias("audit"), repaired_text(c("turns"), c("best.audit")).alias("repaired"),
    )


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults told by crc32 of `conv_id:turn` modulo 20: 0 drops a turn (present is false), 1 empties its text, 2
    takes `.`, `!` and `?` out of it, 3 repeats it, 4 gives it the role user.  Nulls are one space."""
    c = F.col
    named = F.concat(F.coalesce(c("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(c("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv_id", "turn", *(F.coalesce(x, F.lit(" ")).alias(x) for x in ("role", "text")), F.pmod(F.crc32(named), F.lit(20)).alias("kind"))
    text = F.when(c("kind") == 1, "").when(c("kind") == 2, F.translate("text", ".!?", "")).otherwise(c("text"))
    role = F.when(c("kind") == 4, "user").otherwise(c("role"))
    copies = F.explode(F.array_repeat(F.lit(1), F.when(c("kind") == 3, 2).otherwise(1).cast("int")))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (c("kind") != 0).alias("present"), copies.alias("copy")).drop("copy")


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    found = repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("present"))
    return found.withColumn("repaired_sha256", F.sha2("repaired", 256)).drop("repaired")


def _step_sql() -> str:
    """The rows (state, cost, audit, out) behind one more turn, from w (rows with insertions made) and the turn x."""
    stays = "fault NOT IN ('blank', 'duplicate')"
    cut = f"if(fault = 'truncated', {TRUNCATED}, 0)"
    line = "chr(10) || {role} || ':' || text"
    return f"""
    SELECT cid, i + 1 AS i, state, cost + {DELETE} AS cost, audit || 'D' AS audit, out FROM w
    UNION ALL SELECT cid, i + 1, initial, cost + {cut}, audit || 'K', out || {line.format(role="role")} FROM w
      WHERE {stays} AND (state || initial) IN ('-s', '-u', 'su', 'ua', 'au')
    UNION ALL SELECT cid, i + 1, if(state = 'u', 'a', 'u'), cost + {REROLE} + {cut}, audit || 'R', out || {line.format(role="if(state = 'u', 'assistant', 'user')")} FROM w
      WHERE {stays}"""


OP11_SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name
      FROM conversations),
k AS (SELECT h.* EXCLUDE (name), {crc32_sql("name")} % 20 AS kind FROM h, crc_table),
g AS (SELECT conv_id, turn, if(kind = 4, 'user', role) AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
        unnest(if(kind = 3, [1, 2], [1])) AS copy FROM k WHERE kind <> 0),
c AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
p AS (SELECT cid, turn, role, text, row_number() OVER (PARTITION BY cid, role, md5(text) ORDER BY turn NULLS FIRST) > 1 AS again
      FROM g JOIN c ON g.conv_id IS NOT DISTINCT FROM c.conv_id),
r AS (SELECT *, left(role, 1) AS initial, row_number() OVER v AS i, lag(left(role, 1)) OVER v AS before
      FROM p WINDOW v AS (PARTITION BY cid ORDER BY turn NULLS FIRST, role, md5(text), again)),
t AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault FROM r),
f AS (SELECT cid, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
        count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
        count(*) FILTER ((before || initial) NOT IN ('su', 'ua', 'au')) AS illegal FROM t GROUP BY cid),
e AS (
  SELECT cid, 1::BIGINT AS i, '-' AS state, 0 AS cost, '' AS audit, '' AS out FROM f
  UNION ALL (
    WITH one AS (SELECT *, state AS s0 FROM e
      UNION ALL SELECT cid, i, if(state = 'u', 'a', 'u'), cost + {INSERT}, audit || 'I', out || if(state = 'u', chr(10) || 'assistant:', chr(10) || 'user:'), state FROM e
      UNION ALL SELECT cid, i, 'a', cost + {2 * INSERT}, audit || 'II', out || chr(10) || 'user:' || chr(10) || 'assistant:', state FROM e WHERE state <> 'u'),
    w AS (SELECT one.cid, one.i, state, cost, audit, out, role, text, initial, fault FROM one JOIN t ON t.cid = one.cid AND t.i = one.i),
    x AS ({_step_sql()})
    SELECT cid, i, state, m.cost, m.audit, m.out FROM (SELECT cid, i, state, min(struct_pack(cost := cost, audit := audit, out := out)) AS m FROM x GROUP BY cid, i, state))),
z AS (SELECT cid, min(struct_pack(cost := cost, audit := audit, out := out)) AS m FROM (
    SELECT e.cid, cost, audit, out, state FROM e JOIN f ON f.cid = e.cid AND e.i = f.n + 1
    UNION ALL SELECT e.cid, cost + {INSERT}, audit || 'I', out || chr(10) || 'assistant:', 'a' FROM e JOIN f ON f.cid = e.cid AND e.i = f.n + 1 WHERE state = 'u'
    UNION ALL SELECT e.cid, cost + {2 * INSERT}, audit || 'II', out || chr(10) || 'user:' || chr(10) || 'assistant:', 'a' FROM e JOIN f ON f.cid = e.cid AND e.i = f.n + 1 WHERE state <> 'u')
  WHERE state IN ('-', 'a') GROUP BY cid)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(m.cost, 0)::BIGINT AS cost, coalesce(m.audit, '') AS audit, sha256(coalesce(substr(m.out, 2), '')) AS repaired_sha256
FROM c LEFT JOIN f USING (cid) LEFT JOIN z USING (cid)
"""
