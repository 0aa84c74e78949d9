"""The prefix trie against a brute-force version, however the conversations fall into chunks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

import texts as X
from furrow.llm import radix, tries

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def strings(rows):
    """{conv_id: [(role, text), ...]} in order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32] + f"{len(text):08x}"
            out.setdefault(c, []).append(((turn is not None, turn or 0), key, (role, text)))
    return {c: [t for *_, t in sorted(turns)] for c, turns in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        out[c] = base[:h] + turns[h:]
    return out


def nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), set()).add(c)
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}

    def below(n):
        yield n
        for m in children[n]:
            yield from below(m)

    out = []
    for n, ids in members.items():
        tree = list(below(n))
        ends = ",".join(str(c) for c in sorted(ids) if len(convs[c]) == len(n))
        out.append(
            (
                min(ids),
                len(n),
                min(members[n[:-1]]) if n else None,
                len(ids),
                len(children[n]),
                sum(not children[m] for m in tree),
                sum((len(members[m]) - 1) * len(m[-1][1]) for m in tree if m),
                X.sha(ends),
            )
        )
    return X.ordered(out)


def awkward(seed, n):
    rng = random.Random(seed)
    turns = [(None, None), ("user", ""), ("user", "hi"), ("", "üñï 日本 😀"), ("assistant", "x" * 3000), ("us", "erhi"), ("user", "and then?")]
    rows = []
    for c in [*range(n), 200, 201, 305, -3, -103, 10**12, 10**12 + 7]:
        some = rng.choices(turns, [1, 1, 5, 1, 3, 1, 2], k=rng.choice([1, 1, 2, 3, 3, 5, 9]))
        rows += [(c, t if rng.random() < 0.9 else None, *x) for t, x in enumerate(some)]
    rows += [(500 + i, t, "user", f"copy {t}") for i in range(80) for t in range(4)]
    rows += [(600 + i, t, "user", f"copy {t}") for i in range(30) for t in range(1 + i % 7)]
    rows += [(700, t, "user", str(t // 3)) for t in range(300)] + [(None, 0, "user", "nobody"), (500, 0, "user", "copy 0")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk_bytes, again", [(1, False), (70, True), (400, False), (tries.CHUNK_BYTES, True)])
def test_trie_equals_brute_force(spark, chunk_bytes, again):
    rows = awkward(chunk_bytes, 40)
    table = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).repartition(3)
    ids, want = tries.turn_strings(table), strings(rows)
    if again:
        ids, want = tries.rebuilt(ids), rebuilt(want)
    got = tries.trie(ids, chunk_bytes)
    assert X.ordered([tuple(r) for r in got.select(COLUMNS).collect()]) == nodes(want)
    known = {r.node for r in got.select("node").collect()}
    assert len(known) == len(nodes(want)) and all(r.parent in known for r in got.filter("depth > 0").select("parent").collect())


def test_turnless_and_missing_conversations(spark):
    """A conversation may have no turns after rebuilding; an empty table has no node."""
    rows = [(205, 0, "user", "own turn that is replaced by nothing"), (3, None, None, None)]
    got = tries.trie(tries.rebuilt(tries.turn_strings(spark.createDataFrame(rows, SCHEMA))))
    assert X.ordered([tuple(r) for r in got.select(COLUMNS).collect()]) == nodes(rebuilt(strings(rows)))
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.trie(tries.rebuilt(tries.turn_strings(empty))).count() == 0


def test_radix_nodes_grow_and_keep_their_keys():
    rng = random.Random(5)
    keys = {bytes([first, *rng.choices(range(size), k=rng.randrange(1, 5))]) for first, size in [(0, 3), (1, 12), (2, 40), (3, 256)] for _ in range(1500)}
    tree = radix.Tree()
    for key in sorted(keys, key=lambda k: hashlib.sha256(k).digest()):
        tree.insert(key, key)
    kinds, found, stack = set(), [], [(tree.root, b"")]
    while stack:
        node, above = stack.pop()
        kinds.add(type(node))
        at = above + node.label
        if node.ends:
            assert node.ends == [at]
            found.append(at)
        children = list(node.children())
        assert len({c.label[0] for c in children}) == len(children)
        assert node.ends or len(children) > 1 or node is tree.root  # paths are compressed
        stack += [(c, at) for c in children]
    assert sorted(found) == sorted(keys)
    assert kinds == {radix.Node4, radix.Node16, radix.Node48, radix.Node256}
