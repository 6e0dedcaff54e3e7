import random
from collections import Counter

from xxhash import xxh64_intdigest

from saltmarsh.llm import common, simhash


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    ones = Counter(b for s in shingles for h in [xxh64_intdigest(s, 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in ones.items() if 2 * n > len(shingles))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if linked(items[i], items[j]):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def close(a, b):
    return (a ^ b).bit_count() <= 2


def test_whole_operator_against_brute_force(spark, docs, plain):
    found = simhash.near_duplicates(docs).collect()
    prints = [brute_fingerprint(t) for _, t in plain]
    roots = brute_components(prints, close)
    least = {}
    for (i, _), r in zip(plain, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    wanted = Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(plain, prints, roots))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in found) == wanted
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def _links(spark, prints, hot):
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    edges = simhash.links(spark.createDataFrame(signed, "fp bigint"), hot).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 and r.a != r.b for r in edges)
    groups = {r.id: r.component for r in common.components(spark.createDataFrame([(r.a, r.b) for r in edges], "a bigint, b bigint")).collect()}
    return [groups.get(p, p) for (p,) in signed]


def same_partition(a, b):
    return len(set(a)) == len(set(b)) == len(set(zip(a, b)))


def test_no_link_is_lost_in_cold_or_hot_buckets(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(25)]
    prints = set(base)
    for p in base:
        for _ in range(12):
            q = p
            for b in rng.sample(range(64), rng.randint(1, 4)):
                q ^= 1 << b
            prints.add(q)
    prints |= {base[0] ^ 1 << a ^ 1 << b for a in range(12) for b in range(a)}  # a dense bucket
    prints = sorted(prints)
    wanted = brute_components(prints, close)
    for hot in (64, 3, 0):
        assert same_partition(_links(spark, prints, hot), wanted)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1040)] + [(5, 5), (2000, 2001), (2001, 2000)]
    found = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(61)} | {i: 1000 for i in range(1000, 1040)} | {2000: 2000, 2001: 2000}
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_one_each_keeps_columns_and_one_row(spark, docs, plain):
    kept = simhash.one_each(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len(set(brute_components([brute_fingerprint(t) for _, t in plain], close)))
    assert len({brute_fingerprint(r.text) for r in rows}) == len(rows)
    one = spark.createDataFrame([(None, "a b c", 1), (None, "a b c", 1), (4, "q r s", 2), (4, "t u v", 3)], "doc_id bigint, text string, k int")
    assert sorted(str(r.doc_id) + r.text for r in simhash.one_each(one).collect()) == ["4q r s", "4t u v", "Nonea b c"]
