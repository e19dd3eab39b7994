r"""Conversation structure repair over a graph of tight arcs.

A conversation is repaired by edits of its rows: keep, change of role, deletion and insertion of an
empty turn. A node of the graph is (rows read, place in the wanted order of roles), an arc is an edit.
Least costs from the beginning to each node and from each node to the end say which arcs lie on some
cheapest repair; those are the tight arcs. A set of nodes that begins at the first one then goes along
tight arcs, at each step along all those with the least letter, which gives the least string of letters
among all cheapest repairs without listing them.

Costs depend on a row by its kind alone (first letter of its role, fault), and costs relative to their
least one take few values, so each step is looked up after its first time.

Rows travel twice: once without texts, for faults and edits, and once with them, behind the edits of
their conversation. No conversation's texts are held together: a task keeps some bytes for each row
of one conversation.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COST = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
#: What an undeleted truncated row costs besides.
TRUNCATED = 3
#: The order of roles (s?(ua)+)? by first letters: state -> letter -> next state; 0 is the beginning.
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
#: Roles that a row may be given and that an inserted turn may have, by first letter.
GIVEN = {"u": "user", "a": "assistant"}

_INF = float("inf")
_WHITE = " \t\n\x0b\x0c\r"

Costs = tuple[float, ...]


#: Two insertions and a deletion more than from another place always lead on, so a place that costs more is on no cheapest repair.
_FAR = 2 * COST[INSERT] + COST[DELETE]


def _normal(costs: list[float]) -> tuple[Costs, float]:
    least = min(costs)
    return tuple(c - least if c - least <= _FAR else _INF for c in costs), least


def _inserted(costs: list[float], forward: bool) -> list[float]:
    """Costs after any number of insertions; two rounds are enough as no cheapest repair inserts in a circle."""
    for _ in range(2):
        for q, moves in enumerate(MOVES):
            for letter in GIVEN:
                if letter in moves:
                    a, b = (q, moves[letter]) if forward else (moves[letter], q)
                    costs[b] = min(costs[b], costs[a] + COST[INSERT])
    return costs


@functools.cache
def _edits(kind: tuple[str, str]) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) of each edit of a row of that kind (first letter of its role, fault)."""
    letter, fault = kind
    out = [(DELETE, q, q, COST[DELETE]) for q in range(len(MOVES))]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        for q, moves in enumerate(MOVES):
            if letter in moves:
                out.append((KEEP, q, moves[letter], COST[KEEP] + more))
            out += [(REROLE, q, moves[x], COST[REROLE] + more) for x in GIVEN if x in moves]
    return out


@functools.cache
def _after(costs: Costs, kind: tuple[str, str]) -> tuple[Costs, float]:
    """Costs from the beginning after one more row, less the least of them, and that."""
    out = [_INF] * len(MOVES)
    for _, a, b, cost in _edits(kind):
        out[b] = min(out[b], costs[a] + cost)
    return _normal(_inserted(out, True))


@functools.cache
def _before(costs: Costs, kind: tuple[str, str]) -> tuple[Costs, float]:
    """Costs to the end before that row, less the least of them, and that."""
    out = [_INF] * len(MOVES)
    for _, a, b, cost in _edits(kind):
        out[a] = min(out[a], costs[b] + cost)
    return _normal(_inserted(out, False))


BEGIN = _normal(_inserted([0.0] + [_INF] * (len(MOVES) - 1), True))
END = _normal(_inserted([0.0 if q in FINAL else _INF for q in range(len(MOVES))], False))


@functools.cache
def _walk(at: frozenset, ahead: Costs, kind: tuple[str, str] | None, behind: Costs) -> tuple[str, frozenset]:
    """Least letters from the set `at` along tight arcs until the row is read, and the set of nodes then.

    ahead: costs from the beginning here. behind: costs to the end after the row, or here if there is no row left.
    """
    here, shift = _before(behind, kind) if kind else (behind, 0.0)
    best = min(a + b for a, b in zip(ahead, here, strict=True)) + shift
    arcs = [(INSERT, q, m[x], ahead[q] + COST[INSERT] + here[m[x]] + shift) for q, m in enumerate(MOVES) for x in GIVEN if x in m]
    if kind:
        arcs += [(letter, a, b, ahead[a] + cost + behind[b]) for letter, a, b, cost in _edits(kind)]
    tight = [(letter, a, b) for letter, a, b, total in arcs if total == best]
    letters = []
    while step := min((letter for letter, a, _ in tight if a in at), default=""):
        letters.append(step)
        at = frozenset(b for letter, a, b in tight if a in at and letter == step)
        if step != INSERT:
            break
    return "".join(letters), at


def cheapest(kinds: list[tuple[str, str]]) -> tuple[int, str]:
    """Cost and least letters of the cheapest repairs of one conversation, whose rows are of these kinds."""
    if not kinds:
        return 0, ""
    ahead, spent = [BEGIN[0]], BEGIN[1]
    for kind in kinds:
        costs, shift = _after(ahead[-1], kind)
        ahead.append(costs)
        spent += shift
    behind = [END[0]]
    for kind in reversed(kinds[1:]):
        behind.append(_before(behind[-1], kind)[0])
    at, letters = frozenset({0}), []
    for k, kind in enumerate(kinds):
        part, at = _walk(at, ahead[k], kind, behind[-1 - k])
        letters.append(part)
    letters.append(_walk(at, ahead[-1], None, END[0])[0])
    return int(spent + END[1] + min(a + b for a, b in zip(ahead[-1], END[0], strict=True))), "".join(letters)


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, copy, gone of the rows after a damage that crc32(`conv_id:turn`) % 20 decides.

    0 marks a row as gone, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats it (copy 1), 4 makes
    its role user. Null roles and texts are one space, null ids and turns count as one space in the
    checksum alone. Gone rows are left in, so that a conversation whose rows are all gone is known still.
    """
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    rows = turns.select(
        conv.alias("conv_id"), turn.alias("turn"), text(F.col(role_col)).alias("role"), text(F.col(text_col)).alias("text"),
        (F.crc32(F.concat(text(conv), F.lit(":"), text(turn))) % 20).alias("d"),
    )
    copies = F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"), (F.col("d") == 0).alias("gone"),
    )


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)


_AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = ("su", "ua", "au")


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; rows come in order, conversation after conversation."""
    names = [x.split()[0] for x in _AUDIT.split(", ")]
    types = [pa.string() if n == "audit" else pa.int64() for n in names]
    out, held, conv, begun = [], 0, None, False
    kinds, seen, counts, ends, last = [], set(), {}, [None, None, 0], None

    def ended() -> tuple:
        first, most, distinct = ends
        gaps = 0 if first is None else most - first + 1 - distinct
        cost, audit = cheapest(kinds)
        return (conv, gaps, counts.get("blank", 0), counts.get("duplicate", 0), counts.get("truncated", 0), counts.get("illegal", 0), cost, audit)

    for batch in batches:
        for c, turn, role, digest, blank, whole, gone in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if not begun or c != conv:
                if begun:
                    out.append(ended())
                    held += len(out[-1][-1])
                    if len(out) >= 10_000 or held > common.BATCH_BYTES:
                        yield _batch(out, types, names)
                        out, held = [], 0
                conv, begun = c, True
                kinds, seen, counts, ends, last = [], set(), {}, [None, None, 0], None
            if gone:
                continue
            if turn is not None:
                if ends[0] is None:
                    ends[0] = turn
                ends[2] += ends[1] != turn
                ends[1] = turn
            key = (role, digest)
            fault = "blank" if blank else "duplicate" if key in seen else "" if whole else "truncated"
            seen.add(key)
            letter = role[:1]
            if fault:
                counts[fault] = counts.get(fault, 0) + 1
            if last is not None and last + letter not in _LEGAL:
                counts["illegal"] = counts.get("illegal", 0) + 1
            last = letter
            # all other letters are the same to the costs
            kinds.append((letter if letter in ("s", "u", "a") else "", fault))
    if begun:
        out.append(ended())
    if out:
        yield _batch(out, types, names)


def audits(rows: DataFrame) -> DataFrame:
    """Faults, cost and edits of each conversation of `rows` (conv_id, turn, role, text, copy, gone).

    Rows are ordered by turn (null first), then by role, the digest of their text and copy. The first
    fault of a row counts: blank (nothing but white space), duplicate (role and text seen earlier in the
    conversation), truncated (the last other character is none of `.!?`). `illegal` counts neighbours
    whose roles' first letters are not su, ua or au, `gaps` the numbers missing between the least and the
    largest turn. `audit` has one letter for each edit. A conversation whose rows are all gone has zeros
    and an empty audit; null ids make one conversation. Repeated rows are duplicates of each other. Texts
    stay where they are: what is compared is their digest. An empty table gives an empty result.
    """
    text = F.rtrim("text", F.lit(_WHITE))
    light = rows.select(
        "conv_id", "turn", "role", _digest().alias("digest"), (text == "").alias("blank"), F.substring(text, -1, 1).isin(*".!?").alias("whole"), "gone", "copy",
    )
    light = light.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "digest", "copy").drop("copy")
    return light.mapInArrow(_audited, _AUDIT)


_TURNS = "conv_id long, place long, edit string, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns of the repaired conversations; a conversation's edits come before its rows."""
    names = [x.split()[0] for x in _TURNS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out, held, audit, at, place, conv = [], 0, "", 0, 0, None

    def put(edit: str, role: str, text: str) -> None:
        nonlocal place
        out.append((conv, place, edit, role, text))
        place += 1

    def wanted() -> str:
        # the letters fix the roles: with a first system turn kept, the number of turns is odd
        return GIVEN["ua"[(place - odd) % 2]]

    odd = 0
    for batch in batches:
        for c, edits, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if edits is not None:
                conv, audit, at, place = c, edits, 0, 0
                odd = (len(audit) - audit.count(DELETE)) % 2
            else:
                edit = audit[at]
                at += 1
                if edit != DELETE:
                    put(edit, wanted() if edit == REROLE else role, text)
                    held += len(text)
            while at < len(audit) and audit[at] == INSERT:
                put(INSERT, wanted(), "")
                at += 1
                if len(out) >= 10_000:
                    yield _batch(out, types, names)
                    out, held = [], 0
            if len(out) >= 10_000 or held > common.BATCH_BYTES:
                yield _batch(out, types, names)
                out, held = [], 0
    if out:
        yield _batch(out, types, names)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The turns of the repaired conversations: conv_id, place (from 0), edit, role, text.

    `found` is what audits() says of `rows`. Deleted rows are left out, kept ones are as they were, others
    have the role that their place asks for; inserted turns have an empty text. A conversation's turns
    come in order and together, so what reads them row after row needs no shuffle of its own.
    """
    common.bounded_batches(rows.sparkSession)
    none = F.lit(None)
    heads = found.select(
        "conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"),
        none.cast("binary").alias("digest"), F.lit(-1).alias("copy"), "audit",
    )
    body = rows.filter(~F.col("gone")).select("conv_id", "turn", "role", "text", _digest().alias("digest"), "copy", none.cast("string").alias("audit"))
    both = heads.unionByName(body).repartition("conv_id")
    first = F.col("audit").isNull()
    both = both.sortWithinPartitions("conv_id", first, F.asc_nulls_first("turn"), "role", "digest", "copy")
    return both.select("conv_id", "audit", "role", "text").mapInArrow(_edited, _TURNS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, conv, sha = [], None, None
    for batch in batches:
        for c, place, role, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if place == 0:
                if sha:
                    out.append((conv, sha.hexdigest()))
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode())
        if len(out) >= 10_000:
            yield _batch(out, [pa.int64(), pa.string()], ["conv_id", "sha"])
            out = []
    if sha:
        yield _batch([*out, (conv, sha.hexdigest())], [pa.int64(), pa.string()], ["conv_id", "sha"])


@common.settled
def repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation: what audits() says and repaired_sha256 of its repaired `role:text` lines.

    The digest reads the repaired turns where they are, one after the other. A repaired conversation
    without turns has the digest of an empty string.
    """
    found = common.store(audits(rows), "audits")
    shas = repaired(rows, found).select("conv_id", "place", "role", "text").mapInArrow(_hashed, "conv_id long, sha string")
    shas = shas.withColumnRenamed("conv_id", "of")
    sha = F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return found.join(shas, F.col("conv_id").eqNullSafe(F.col("of")), "left").select(*found.columns, sha)
