"""Cost-balanced packing, Merkle proofs and conversation repair against brute force, and the cases that their docstrings define."""

import hashlib
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import balance, merkle, packing, repair

# --- cost-balanced packing ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=60), st.booleans())
def test_assignment_fills_all_room(lengths, last):
    room = balance.capacities(sum(lengths), 40, last)
    assert sum(room) == sum(lengths) and (not last or all(r == 40 or r & (r - 1) == 0 for r in room))
    parts = list(balance.assign(lengths, room))
    for k, n in enumerate(lengths):  # each piece is whole again, without gaps
        own = sorted((a, m) for p, a, m, _, _ in parts if p == k)
        assert [a for a, _ in own] == list(np.cumsum([0, *(m for _, m in own)])[:-1]) and sum(m for _, m in own) == n
    for s, r in enumerate(room):
        own = sorted((at, m) for _, _, m, q, at in parts if q == s)
        assert [a for a, _ in own] == list(np.cumsum([0, *(m for _, m in own)])[:-1]) and sum(m for _, m in own) == r


def test_assignment_takes_the_cheapest_sequence_with_room():
    assert [(p, s) for p, _, _, s, _ in balance.assign([5, 9, 4, 6], [12, 12])] == [(1, 0), (3, 1), (0, 1), (2, 0), (2, 1)]
    # the piece of 4 fits nowhere (3 and 1 are free): it fills the cheaper sequence, and its rest the other
    assert list(balance.assign([5, 9, 4, 6], [12, 12]))[-2:] == [(2, 0, 3, 0, 9), (2, 3, 1, 1, 11)]


def packed_rows(spark, docs, **kw):
    return balance.pack(balance.document_pieces(docs, **{k: v for k, v in kw.items() if k == "capacity"}), **kw).collect()


@pytest.mark.parametrize(("groups", "fan_in"), [(256, 256), (2, 3)])
def test_balanced_sequences_hold_all_ids(spark, sf, monkeypatch, groups, fan_in):
    monkeypatch.setattr(balance, "GROUP_SEQUENCES", groups)
    monkeypatch.setattr(balance, "FAN_IN", fan_in)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bpe, capacity = packing.word_bpe("word_bpe_49k.json"), 4096
    rows = packed_rows(spark, docs)
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length > 0
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for r in docs.collect():
        own = sorted(by_doc.pop(r.doc_id), key=lambda p: p.start)
        ids = [*bpe.encode(r.text or "").tolist(), 2]
        assert [i for p in own for i in np.frombuffer(p.ids, "<u4")] == ids and {p.doc_tokens for p in own} == {len(ids)}
    assert not by_doc
    sizes = []
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == list(np.cumsum([0, *(p.length for p in own)])[:-1])
        sizes.append(sum(p.length for p in own))
    assert all(n == capacity or n < capacity and n & (n - 1) == 0 for n in sizes) and sum(n < capacity for n in sizes) <= 12
    assert 4 * sum(sizes) == sum(len(r.ids) for r in rows)
    if groups == 256:  # one group: no sequence of whole length costs more than the costliest piece or a third above the mean
        costs = [r.cost for r in balance.sequence_costs(balance.pack(balance.document_pieces(docs))).where("tokens = 4096").collect()]
        assert max(costs) <= max(1.34 * np.mean(costs), balance.LINEAR * capacity + balance.QUADRATIC * capacity**2)


def test_balanced_packing_edges(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, "a b", "y"), (None, "a b", "y"), (2, "word " * 30, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket string")
    got = packed_rows(spark, docs, capacity=8)
    assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == [("1", 1), ("1", 1), ("2", 31), ("None", 3), ("None", 3)]
    assert sum(r.length for r in got) == 39 and all(r.offset + r.length <= 8 for r in got)
    assert packed_rows(spark, docs.limit(0)) == []


# --- Merkle manifest ---


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def tree(nodes):
    """The root of nodes, and each one's siblings, level by level."""
    proofs, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = range(i // 16 * 16, min(i // 16 * 16 + 16, len(level)))
            proofs[k] += [level[j] for j in run if j != i]
            at[k] = i // 16
        level = [H(level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], proofs


def brute_proofs(rows):
    """(doc_id, leaf, subroot, root, proof) of rows of the fields."""
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, H(map(said, r))))
    told, subroots = [], []
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        own = sorted(by[s])
        top, proofs = tree([leaf for *_, leaf in own])
        subroots.append(top)
        told.append([(i if known else None, leaf, top, p) for (known, i, leaf), p in zip(own, proofs)])
    root, upper = tree(subroots)
    return [(i, leaf, top, root, p + up) for own, up in zip(told, upper) for i, leaf, top, p in own]


MERKLE = "doc_id long, source string, lang string, n_chars long, text string, src string, place long"


@pytest.mark.parametrize("height", [1, 2, 3])
def test_proofs_are_brute_forces(spark, height):
    rng = np.random.default_rng(4)
    rows = [(int(i), "hot", "en", 1, f"T{i}") for i in range(300)] + [(int(i) if i % 9 else None, [None, "", "é", "z", "A"][int(i) % 5], None, int(i), None if i % 7 == 0 else f"X{i} é") for i in rng.integers(0, 200, 90)]
    rows += [(i, f"s{i}", "en", None, "One") for i in range(20)] + [(5, "hot", "en", 1, "T5")] * 40
    docs = spark.createDataFrame([(*r, "c", 1) for r in rows], MERKLE)
    got = merkle.prove(docs, claimed=merkle.tampered(docs), height=height, with_proof=True).collect()
    key = lambda r: str((r[0], r[1], r[4]))
    want = sorted(brute_proofs(rows), key=key)
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in got), key=key) == want
    assert all(r.proof_sha256 == H(r.proof) and r.verified == (r.folded_root == r.root) for r in got)
    hit = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    changed = {str(r[0]) for r in rows if hit(r[0]) and r[4] and r[4] != r[4].lower()}
    assert {str(r.doc_id) for r in got if not r.verified} == changed and changed


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 70), st.integers(0, 2**30))
def test_traversal_gives_every_path(n, seed):
    leaves = [H([str(seed + i)]) for i in range(n)]
    height, nodes = 0, n
    while nodes > 1:
        height, nodes = height + 1, -(-nodes // 3)
    walk = merkle.Traversal(leaves, height, arity=3)
    for leaf, path in zip(leaves, walk.paths(), strict=True):
        assert merkle.folded(leaf, path) == walk.root and (not path or path[0][1][path[0][0]] == leaf)
        assert len(walk.existing) == height and all(len(x) <= 3 for x in walk.existing + walk.desired)


def test_proofs_of_few_rows(spark):
    one = spark.createDataFrame([(7, None, None, None, None, "c", 1)], MERKLE)
    got = merkle.prove(one).collect()
    leaf = H(["1:7", "-", "-", "-", "-"])
    assert [tuple(r) for r in got] == [(7, leaf, leaf, leaf, H([]), leaf, True)]
    assert merkle.prove(one.limit(0)).collect() == []


# --- conversation repair ---


def brute_repair(rows):
    """(cost, audit, repaired) of rows (role, text): all edits of the least cost, by trying them."""
    seen, kinds = set(), []
    for role, text in rows:
        empty = not re.search(r"[^\x20\x09-\x0D]", text)
        again = (role, text) in seen
        seen.add((role, text))
        kinds.append((empty or again, not empty and not again and re.search(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D]*\Z)", text)[0] not in ".!?"))
    good = re.compile(r"(s?(ua)+)?")

    def scripts(i, left, initials, audit, lines):
        if not re.fullmatch(r"(s?(ua)*u?)?", initials):
            return
        if i == len(rows) and good.fullmatch(initials):
            yield audit, lines
        if left >= 2:
            for role in ("user", "assistant"):
                yield from scripts(i, left - 2, initials + role[0], audit + "I", [*lines, f"{role}:"])
        if i < len(rows):
            (role, text), (must, cut) = rows[i], kinds[i]
            if left >= 3:
                yield from scripts(i + 1, left - 3, initials, audit + "D", lines)
            if not must:
                if left >= cut:
                    yield from scripts(i + 1, left - cut, initials + (role[:1] or "?"), audit + "K", [*lines, f"{role}:{text}"])
                if left >= 2 + cut:
                    for new in ("user", "assistant"):
                        yield from scripts(i + 1, left - 2 - cut, initials + new[0], audit + "R", [*lines, f"{new}:{text}"])

    for cost in range(99):
        if found := list(scripts(0, cost, "", "", [])):
            return cost, *min(found)


ROLES, TEXTS = st.sampled_from(["user", "assistant", "system", "tool", ""]), st.sampled_from(["Yes.", "No", " ", "Why? ", "Stop!\n", "x"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=5))
def test_repair_is_the_cheapest_and_least(rows):
    talk, seen = repair._Conversation(1), set()
    for turn, (role, text) in enumerate(rows):
        empty, first = not re.search(r"[^\x20\x09-\x0D]", text), (role, text) not in seen
        seen.add((role, text))
        talk.rows.append((turn, role, text, empty, not re.search(r"[.!?][\x20\x09-\x0D]*\Z", text), first))
    lines = [f"{role}:{text}" for letter, _, role, text in talk.step(True) if letter != "D"]
    assert (talk.cost, "".join(talk.audit), lines) == brute_repair(rows)
    assert talk.sha.hexdigest() == hashlib.sha256("\n".join(lines).encode()).hexdigest()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans(), st.sampled_from("suax")), min_size=2, max_size=12), st.integers(1, 11))
def test_matrices_of_chunks_give_the_costs_of_the_whole(kinds, at):
    whole = repair.costs_to_go(kinds, repair.END)
    m = repair.matrix(kinds[:at])
    after = whole[min(at, len(kinds))]
    assert tuple(min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)) == whole[0]


TALK = "conv_id long, turn long, role string, text string, place long, kind string"


def test_repair_of_odd_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 0, "user", "Hi."), (1, 2, "assistant", None), (2, None, None, "So?"), (None, 5, "user", "Hm."), (None, None, "assistant", "Hm."), (3, 0, "user", "Long " * 20000)]
    talks = spark.createDataFrame([(*r, 1, "c") for r in rows], TALK)
    got = {r.conv_id: tuple(r)[1:8] for r in repair.report(talks, talks.unionByName(talks.limit(1).withColumn("conv_id", F.lit(9).cast("long")))).collect()}
    assert got == {1: (1, 1, 1, 0, 1, 8, "KDDI"), 2: (0, 0, 0, 0, 0, 3, "D"), None: (0, 0, 0, 0, 0, 4, "IKKI"), 3: (0, 0, 0, 1, 0, 3, "D"), 9: (0, 0, 0, 0, 0, 0, "")}
    assert repair.report(talks.limit(0), talks.limit(0)).collect() == [] and repair.repaired_turns(talks.limit(0)).collect() == []
    turns = [tuple(r)[1:] for r in repair.repaired_turns(talks.where("conv_id = 1")).orderBy("place").collect()]
    assert [t[1] for t in turns] == list(got[1][6]) and all(t[2] is None for t in turns if t[1] == "I")


def test_long_conversations_go_by_chunks(spark):
    rng = np.random.default_rng(3)
    rows = [(c, int(t) if rng.random() > 0.02 else None, str(rng.choice(["user", "assistant", "system"])), str(rng.choice(["Yes.", "No", "", "Why?", "Go on."])) + " " * int(rng.integers(0, 30))) for c, n in ((1, 90), (2, 3), (None, 40)) for t in range(n)]
    talks = spark.createDataFrame([(*r, 1, "c") for r in rows], TALK)
    whole = sorted(map(str, repair.report(talks, talks).collect()))
    assert sorted(map(str, repair.report(talks, talks, chunk=7).collect())) == whole == sorted(map(str, repair.report(talks, talks, chunk=1).collect()))
    turns = lambda chunk: sorted(map(str, repair.repaired_turns(talks, chunk).collect()))
    assert turns(7) == turns(1024)


def test_damage_and_report_are_sqls(spark, sf):
    talks = spark.read.parquet(f"{sf}/conversations.parquet")
    odd = spark.createDataFrame([(-1, None, None, None), (-1, 3, "user", None), (-2, 1, "", "x")], "conv_id long, turn long, role string, text string")
    both = talks.select("conv_id", "turn", "role", "text").unionByName(odd)
    con = duckdb.connect()
    con.register("conversations", both.toArrow())
    want = con.sql(repair.report_sql()).fetchall()
    assert sorted(map(tuple, repair.report(repair.damaged(both), both, chunk=3).collect())) == sorted(want)
