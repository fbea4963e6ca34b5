"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from pixelmill.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long, n long, g string, len long"


def plain(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            convs[c].append(((turn is not None, turn or 0), role, key, text))
    convs = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = convs.get(base, [])[:h] + own[h:]
    ids, above, last = {}, {0: None}, {0: 0}
    members, ends, depth, kids, leaves, saved = defaultdict(list), defaultdict(list), {0: 0}, Counter(), Counter(), Counter()
    for c in sorted(built):
        p = 0
        members[p].append(c)
        for turn in built[c]:
            if (p, turn) not in ids:
                q = ids[p, turn] = len(above)
                above[q], last[q], depth[q] = p, len(turn[1]), depth[p] + 1
                kids[p] += 1
            p = ids[p, turn]
            members[p].append(c)
        ends[p].append(c)
    for p in list(members):
        q, value = p, (len(members[p]) - 1) * last[p]
        while q is not None:
            leaves[q] += not kids[p]
            saved[q] += value
            q = above[q]
    out = Counter()
    for p, m in members.items():
        parent = min(members[above[p]]) if p else None
        digest = hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
        out[(min(m), depth[p], parent, len(m), kids[p], leaves[p], saved[p], digest)] += 1
    return out


def conversations():
    rng = random.Random(4)
    words = [f"w{i} é🙂" for i in range(40)]
    rows = []

    def say(c, texts):
        rows.extend((c, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(texts))

    hot = [words[0] * 3, words[1], words[2] * 2, words[3]]
    for c in range(260):
        kind = rng.random()
        if kind < 0.3:
            say(c, hot + rng.choices(words, k=rng.randint(0, 4)))
        elif kind < 0.5:
            say(c, hot[: rng.randint(1, 4)])
        else:
            say(c, rng.choices(words[:6], k=rng.randint(1, 9)))
    for c in range(260, 300):
        say(c, hot[:2] + [words[9]] * 4)  # one large group of copies
    say(-150, rng.choices(words, k=8))
    say(-1, rng.choices(words, k=2))
    say(735, [words[5]])  # its base has no rows
    say(980_000, rng.choices(words, k=1300))  # longer than a stride
    say(980_001, rng.choices(words, k=7))
    rows += [(980_001, 3, "user", "tie"), (980_001, 3, "user", "other tie"), (980_001, None, "system", None), (980_001, None, None, "null role")]
    rows += [(None, 0, "user", "nobody's"), rows[5], rows[5], rows[300]]
    return rows


@pytest.fixture(scope="module")
def given(spark):
    return spark.createDataFrame([(*r, 1, 2, "g", 3) for r in conversations()], SCHEMA).repartition(3)


def test_trie(given):
    found = trie.rebuilt_trie(given)
    assert ", ".join(f"{n} {'string' if t == 'string' else 'long'}" for n, t in found.dtypes) == trie.NODE
    assert Counter(tuple(r) for r in found.collect()) == plain(conversations())


def test_oversized_subtries_are_dealt_again(given):
    """With at most 40 rows a task, shared turns come from tables; the nodes are the same."""
    assert Counter(tuple(r) for r in trie.rebuilt_trie(given, max_rows=40).collect()) == plain(conversations())


def test_no_conversations(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(735, 0, None, None, 1, 2, "g", 3), (None, 0, "user", "a", 1, 2, "g", 3)], SCHEMA)
    assert Counter(tuple(r) for r in trie.rebuilt_trie(one).collect()) == plain([(735, 0, None, None), (None, 0, "user", "a")])
