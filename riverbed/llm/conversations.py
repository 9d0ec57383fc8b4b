"""Conversation structure: faults of turns, and the cheapest edits that give a conversation a legal order of roles."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: States of the grammar (s?(ua)+)?: nothing yet, system said, user said, assistant said.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: What the edits cost, and what a truncated turn that stays costs besides.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK = " \t\n\x0b\x0c\r"
#: Characters of an audit that wait for the states to agree on them.
TAIL = 256


def damage(turns: DataFrame) -> DataFrame:
    """Rows conv_id, turn, role, text, gone with faults planted by the CRC-32 of `conv_id:turn` modulo 20.

    0 drops a row (it stays as a marker with gone set, so that no conversation is lost), 1 empties its text, 2 removes `.`, `!` and `?`, 3 repeats it, 4 makes it the user's. A
    null role or text is one space, and so is a null conv_id or turn where the CRC-32 reads it.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    changed = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.col("kind") == 0, F.when(F.col("kind") == 3, 2).otherwise(1))).alias("gone")
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), changed.alias("text"), copies)


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("text").asc()]


def faults(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, gone) with blank, early and truncated; early is false where role and text stand in an earlier turn.

    Equal rows of one turn are neighbours in the order of turn, role and text, so which of them repeats another is seen there. The first turn of each role and text is a minimum, which combines before
    the shuffle; texts are met by digest.
    """
    rows = turns.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    key = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    first = rows.filter(~F.col("gone")).groupBy("conv_id", "role", "digest").agg(F.min(key).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    last = F.rtrim("text", F.lit(BLANK))
    return met.select(
        "conv_id", "turn", "role", "text", "gone", (last == "").alias("blank"), (F.col("gone") | F.col("first").eqNullSafe(key)).alias("early"), (~F.right(last, F.lit(1)).isin(".", "!", "?")).alias("truncated")
    )


class Repair:
    """Forward Viterbi over the grammar's states. Each holds the least (cost, audit) that leads to it, and the digest of the turns that it has made.

    Of two audits over the same rows that cost the same, neither begins with the other, as inserts are all they could differ by; so the least audit of a state
    stays least whatever follows. What all states' audits begin with is set apart, so a step handles their ends only.
    """

    def __init__(self) -> None:
        self.agreed: list[str] = []
        self.states: dict[int, tuple] = self.close({NOTHING: (0, "", hashlib.sha256(), NOTHING, ())})

    def close(self, layer: dict[int, tuple]) -> dict[int, tuple]:
        """Ends a turn's layer: up to two turns inserted after it, a user's and an assistant's. No third could pay."""
        for target, role, sources in ((USER, "user:", (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, "assistant:", (USER,))):
            for q in sources:
                if q in layer:
                    cost, audit, digest, begun, lines = layer[q]
                    self.offer(layer, target, cost + INSERT, audit + "I", digest, begun, (*lines, role))
        # a conversation that has an answer can do what one without turns can: delete what that one keeps as a system turn
        known = layer[ASSISTANT][0] if ASSISTANT in layer else None
        out = {}
        for q, (cost, audit, digest, begun, lines) in layer.items():
            if known is None or q in (USER, ASSISTANT) or cost <= known + (DELETE if q == NOTHING else 0):
                if lines:
                    digest = digest.copy()
                    digest.update((("\n" if begun else "") + "\n".join(lines)).encode())
                out[q] = (cost, audit, digest, q, ())
        return out

    @staticmethod
    def offer(layer: dict[int, tuple], q: int, cost: int, audit: str, digest: object, begun: int, lines: tuple) -> None:
        if q not in layer or (cost, audit) < layer[q][:2]:
            layer[q] = (cost, audit, digest, begun, lines)

    def add(self, role: str, text: str, useless: bool, truncated: bool) -> None:
        """One more turn; a useless one can only be deleted."""
        layer: dict[int, tuple] = {}
        stays = TRUNCATED if truncated else 0
        for q, (cost, audit, digest, begun, _) in self.states.items():
            self.offer(layer, q, cost + DELETE, audit + "D", digest, begun, ())
            if useless:
                continue
            target, name = (ASSISTANT, "assistant") if q == USER else (USER, "user")
            self.offer(layer, target, cost + REROLE + stays, audit + "R", digest, begun, (f"{name}:{text}",))
            initial = role[:1]
            if initial == name[0] or initial == "s" and q == NOTHING:
                self.offer(layer, SYSTEM if initial == "s" else target, cost + stays, audit + "K", digest, begun, (f"{role}:{text}",))
        self.states = self.close(layer)
        if len(next(iter(self.states.values()))[1]) > TAIL:
            same = os.path.commonprefix([s[1] for s in self.states.values()])
            self.agreed.append(same)
            self.states = {q: (s[0], s[1][len(same) :], *s[2:]) for q, s in self.states.items()}

    def best(self) -> tuple[int, str, str]:
        """Cost, audit and digest of the cheapest legal conversation."""
        cost, audit, digest = min((self.states[q][:3] for q in (NOTHING, ASSISTANT) if q in self.states), key=lambda s: s[:2])
        return cost, "".join(self.agreed) + audit, digest.hexdigest()


class _Report:
    """What one conversation's turns, in order, amount to."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.before, self.repair = conv_id, None, Repair()
        self.least = self.most = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str, blank: bool, early: bool, truncated: bool) -> None:
        before, self.before = self.before, (turn, role, text)
        if turn is not None and (before is None or before[0] != turn):
            self.least, self.most, self.turns = turn if self.least is None else self.least, turn, self.turns + 1
        if before is not None and before[1][:1] + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        duplicate = not blank and (not early or before == self.before)
        truncated = truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        self.repair.add(role, text, blank or duplicate, truncated)

    def row(self) -> tuple:
        gaps = 0 if self.least is None else self.most - self.least + 1 - self.turns
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *self.repair.best())


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *_order())


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for every conversation of turns (conv_id, turn, role, text, gone; see damage).

    A conversation's turns stand in the order of turn (nulls first), then role, then text. A turn's first fault counts: blank, duplicate (role and text stood before), truncated (no closing mark). Edits: K keep, R
    rerole, D delete (all that helps blank and duplicate turns), I insert an empty turn. The audit is the cheapest that makes the roles (s?(ua)+)?, the least of those that cost the same.

    Conversations stream through sorted partitions, batch by batch: of one of any length only four states are held, and its audit, which is in the result. Its rows do pass one task, in order, as a
    digest of its turns can be made no other way; what is found per row (damage, faults) is spread before that. The states' audits agree but for their last turns; were they not
    to, a step would cost as much as they differ in. Rows with a null conv_id are one conversation. Null turns count for no gap. Rows of a role that begins with none of s, u, a must be
    reroled or deleted. Repeated rows are duplicates. A conversation of which all rows are gone has zeros and the digest of nothing. Only the named columns are read. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report: _Report | None = None
        schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for batch in batches:
            done = []
            for conv, turn, role, text, gone, blank, early, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if report is None or report.conv_id != conv:
                    if report is not None:
                        done.append(report.row())
                    report = _Report(conv)
                if not gone:
                    report.add(turn, role, text, blank, early, truncated)
            if done:
                yield pack(done)
        if report is not None:
            yield pack([report.row()])

    out = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _in_order(faults(turns)).mapInArrow(run, out)


def repaired_turns(turns: DataFrame, report: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text: the turns of each conversation after the edits of its audit in report. turns as for repair()."""
    head = report.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    rows = head.unionByName(turns.filter(~F.col("gone")).select("conv_id", "turn", "role", "text", F.lit(None).cast("string").alias("audit")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, place = "", 0, 0
        for batch in batches:
            done: list[tuple] = []

            def put(conv: int | None, role: str, text: str) -> None:
                nonlocal place
                done.append((conv, place, role, text))
                place += 1

            def inserts(conv: int | None, last: list[str]) -> None:
                nonlocal at
                while at < len(audit) and audit[at] == "I":
                    last[0] = "assistant" if last[0][:1] == "u" else "user"
                    put(conv, last[0], "")
                    at += 1

            for conv, turn, role, text, edits in zip(*(c.to_pylist() for c in batch.columns)):
                if edits is not None:
                    audit, at, place, last = edits, 0, 0, [""]
                else:
                    edit, at = audit[at], at + 1
                    if edit != "D":
                        last = [role if edit == "K" else "assistant" if last[0][:1] == "u" else "user"]
                        put(conv, last[0], text)
                inserts(conv, last)
            if done:
                conv, k, role, text = zip(*done)
                yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(k, pa.int64()), pa.array(role, pa.string()), pa.array(text, pa.string())], ["conv_id", "place", "role", "text"])

    # a conversation's audit comes before its turns
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())
    return ordered.mapInArrow(run, "conv_id long, place long, role string, text string")
