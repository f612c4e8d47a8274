"""MinHash near copies, conversation tries and the divergence audit against plain Python."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from terracell.llm import divergence, minhash, prefix_trie, transducer

from .brute import WORD, sha


# near copies


def shingles(text, words):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset()


def brute_components(rows, words=4, num=4, den=5):
    """(id, n, component) of every row; nodes are row numbers, links by comparing all pairs."""
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and den * both >= num * (len(a) + len(sets[j]) - both):
                parent[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    return sorted(
        ((k, len(sets[i]), least.get(top(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)), key=repr
    )


def near(spark, rows, kind="long", **options):
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    out = minhash.near_components(df, **({"words": 4, "num": 4, "den": 5} | options)).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return sorted((tuple(r)[:3] for r in out), key=repr)


def changed(text, share, rnd):
    return " ".join(w if rnd.random() > share else w + "x" for w in text.split())


def near_group(prose, n, seed):
    rnd = random.Random(seed)
    base = prose(200, seed)
    return [changed(base, rnd.choice([0, 0.01, 0.02, 0.04]), rnd) for _ in range(n)]


def test_near_copies_as_brute_force(spark, prose):
    texts = [t for s in range(6) for t in near_group(prose, 4 + 6 * s, s)]
    rows = [(i * 7 % 1000, t) for i, t in enumerate(texts)]
    assert near(spark, rows) == brute_components(rows)


def test_near_copies_edges(spark, prose):
    a, rnd = prose(120, 1), random.Random(3)
    b = changed(a, 0.01, rnd)
    long = prose(60_000, 9)
    rows = [
        (None, a), (9, b), (9, prose(80, 2)), (4, None), (5, ""), (6, " \n\t"), (None, None), (7, "one two"), (8, "ONE  two"),
        (10, a), (10, a), (None, prose(70, 4)), (11, long), (12, long + " more words at the end"),
    ]
    assert near(spark, rows) == brute_components(rows)
    assert near(spark, []) == []
    named = [(None if k is None else f"d{k:03d}", t) for k, t in rows]
    assert near(spark, named, "string") == brute_components(named)
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS keys", "3 AS id")
    out = minhash.near_components(df, words=4, num=4, den=5).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, out), key=repr) == brute_components(rows)


def test_hot_keys_lose_no_link(spark, prose, monkeypatch):
    """Texts that share most keys and link only in chains: blocks of one or two rows find what stars do not."""
    monkeypatch.setattr(minhash, "BLOCK", 600)
    base = prose(300, 5).split()
    texts = []
    for i in range(60):  # neighbours differ in eight places, far ones in many
        own = list(base)
        for k in range(i // 4 * 8, i // 4 * 8 + 8):
            own[k % 300] = f"n{i // 4}"
        for k in range(i % 4 * 3):
            own[(i * 5 + k * 17) % 300] = f"m{i % 4}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    assert near(spark, rows) == brute_components(rows)


def test_estimate_takes_chance_off():
    import numpy as np

    rnd = np.random.default_rng(1)
    a, b = (rnd.integers(0, 2**64, 4000, dtype=np.uint64) for _ in range(2))
    for shared in (0, 1000, 3000, 4000):
        both = [np.concatenate([a[:shared], x[shared:]]) for x in (a, b)]
        sig = minhash.packed(minhash.minima(both)).view(np.uint64)
        x = sig[0] ^ sig[1]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        equal = minhash.HASHES - int(np.bitwise_count(x & minhash.GROUPS).sum())
        assert minhash.estimate(equal) == pytest.approx(shared / (8000 - shared), abs=0.16)
    assert 75 <= minhash.least_equal(4, 5) <= 90


# conversations


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(turns.get(c - int(math.fmod(c, 20)), [])[:h] + turns[c][h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
            if d:
                kids[built[c][: d - 1]].add(built[c][:d])
    weight = {n: (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0 for n, m in members.items()}
    out = []
    for n, m in members.items():
        below = [k for k in members if k[: len(n)] == n]
        ends = ",".join(str(c) for c in m if len(built[c]) == len(n))
        out.append((
            m[0], len(n), members[n[:-1]][0] if n else None, len(m), len(kids[n]), sum(not kids[k] for k in below),
            sum(weight[k] for k in below), sha(ends),
        ))
    return sorted(out, key=repr)


def trie(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    return sorted(map(tuple, prefix_trie.prefix_trie(df.selectExpr("*", "1 AS d", "2 AS conv")).collect()), key=repr)


def test_trie_as_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for c in range(90):
        for turn in range(rnd.choice([0, 1, 2, 3, 5, 8])):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"say {rnd.randint(0, 1 + turn // 2)} of it"))
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_edges(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "STRETCH", 7)
    rows = [(0, None, None, None), (0, 0, "user", "hello there"), (1, 5, "user", None), (1, 5, "user", None), (21, 1, None, "x")]
    rows += [(None, 1, "user", "lost"), (45, 0, "user", "a b"), (45, 0, "assistant", "a b"), (-3, 1, "user", "minus")]
    rows += [(c, t, "user", "one and the same") for c in (2, 3, 4, 5, 6) for t in range(3)]
    rows += [(60, t, "user", f"turn {t // 2}") for t in range(300)] + [(61, t, "user", f"turn {t // 2}") for t in range(300)]
    ties = [r for r in rows if r[0] != 45]  # turns that tie with other roles are ordered by hash
    assert trie(spark, ties) == brute_trie(ties)
    assert trie(spark, rows) == trie(spark, rows[::-1])
    assert trie(spark, []) == [] and trie(spark, [(None, 1, "user", "lost")]) == []


def test_products_compose_and_are_undone():
    rnd = random.Random(2)
    one, two, three = (prefix_trie.turn_map(rnd.getrandbits(64) - 2**63, rnd.getrandbits(64) - 2**63) for _ in range(3))
    then = prefix_trie.then
    assert then(then(one, two), three) == then(one, then(two, three))
    point = prefix_trie.START
    assert prefix_trie.image(then(one, two), point) == prefix_trie.image(two, prefix_trie.image(one, point))
    assert prefix_trie.origin(one, prefix_trie.image(one, point)) == point
    assert then(one, two) != then(two, one)


def test_a_collision_starts_again(spark, monkeypatch):
    rows = [(c, t, "user", f"{c} {t}") for c in range(4) for t in range(2)]
    seen = []
    real = prefix_trie.same_turns
    monkeypatch.setattr(prefix_trie, "same_turns", lambda *a: seen.append(a[-1]) or (len(seen) > 1 and real(*a)))
    assert trie(spark, rows) == brute_trie(rows)
    assert seen == [0, 1]


# divergence


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if ord(c) > 127 or "a" <= c <= "z" else " " for c in text or "").split(" ")


def brute_audit(rows, least=3, top=200):
    docs = [(lang or "", source or "", [t for t in fold(text) if t]) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        counts = {s: Counter() for s in {d[1] for d in own}}
        for _, s, terms in own:
            counts[s].update(t for t in terms if t in kept)

        def shares(c):
            total = sum(c.values())
            return {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))

        def ranked(s, part, values, most):
            order = sorted(values, key=lambda v: (-v[1], v[0].encode()))[:most]
            return [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(order)]

        for s in counts:
            gaps = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            out += ranked(s, "pair", gaps, None)
            out += ranked(s, "term", [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]], top)
    return sorted(out)


def audited(spark, rows, **options):
    df = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 AS n", "2 AS term").repartition(4)
    return sorted(map(tuple, divergence.audit(df, **options).collect()))


def test_audit_as_brute_force(spark, monkeypatch):
    rnd = random.Random(11)
    stock = ["é" * (i % 3) + chr(97 + i % 26) * (1 + i % 4) + chr(945 + i % 7) * (i % 2) for i in range(400)]
    rows = [
        (rnd.choice(["aa", "bb"]), f"s{rnd.randint(0, 5)}", rnd.choice([" ", "-", "1"]).join(rnd.choices(stock, k=rnd.randint(0, 60))).title())
        for _ in range(150)
    ]
    rows += [("bb", "only", "unheard words"), ("cc", "x", "a b"), ("cc", "y", None), (None, None, "Ab aB ab"), (None, "s", "AB"), ("", "s", "ab")]
    assert audited(spark, rows, top=20) == brute_audit(rows, top=20)
    # shards of seven terms, a pass over the texts for each few
    monkeypatch.setattr(divergence, "PACK_BYTES", 4000)
    assert audited(spark, rows) == brute_audit(rows)


def test_audit_edges(spark):
    assert audited(spark, []) == []
    rows = [("a", "s", "one"), ("a", "t", "two"), ("b", "s", ""), ("b", None, None)]
    assert audited(spark, rows) == brute_audit(rows)
    long = [("a", s, "word " * 300_000 + "x" * 30_000 + " tail") for s in ("s", "s", "t")] + [("a", "t", "other tail")]
    assert audited(spark, long) == brute_audit(long)


def test_transducer():
    rnd = random.Random(5)
    terms = sorted({bytes(rnd.choices(b"abc\xc3\xff", k=rnd.randint(1, 7))) for _ in range(3000)})
    t = transducer.Transducer.from_bytes(transducer.Transducer.build(terms).to_bytes())
    assert list(t.terms()) == terms
    assert t.ordinals(terms).tolist() == list(range(len(terms)))
    others = [x for x in (bytes(rnd.choices(b"abcd\xc3\xff", k=4)) for _ in range(500)) if x not in set(terms)]
    assert (t.ordinals([*others, b"", b"zz"]) == -1).all()
    # minimal: no two states have the same suffixes
    suffixes = {}
    for prefix in {x[:i] for x in terms for i in range(len(x) + 1)}:
        suffixes[frozenset(x[len(prefix) :] for x in terms if x.startswith(prefix))] = 1
    assert len(t.final) == len(suffixes)
    with pytest.raises(ValueError):
        transducer.Transducer.build([b"b", b"a"])
    assert transducer.Transducer.build([]).ordinals([b"a"]).tolist() == [-1]


def test_shards_of_one_language():
    terms = sorted({f"w{i}".encode() for i in range(100)})
    parts = [terms[i : i + 7] for i in range(0, 100, 7)]
    shards = [(p[0], i * 7, transducer.Transducer.build(p).to_bytes()) for i, p in enumerate(parts)]
    asked = [*terms, b"a", b"w", b"zz"]
    assert transducer.Vocabulary(shards).ordinals(asked).tolist() == [*range(100), -1, -1, -1]
