"""Keys that a large part of all rows share: joins, dealing out, and whole results against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sigspark.llm import common, langid, mixing, ngram_join, sharding, token_files
from sigspark.llm.common import materialize, numbered_copies, shared_path, skew_join
from sigspark.llm.components import connected_components


def hot_docs(n=400):
    """A third of the rows are equal, a third share the null id."""
    return [(7, "same text")] * n + [(None, f"t{i % 90}") for i in range(n)] + [(1000 + i, f"text {i} " * (i % 5)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(6)


def test_skew_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    r = random.Random(1)
    left = [(r.choice([1, 1, 1, 2, *range(3, 60)]), i) for i in range(900)] + [(None, -1)] * 50
    right = [(k, f"v{k}") for k in range(0, 50)] + [(1, "again")]
    a = materialize(spark.createDataFrame(left, "k long, i long"), "a")
    b = spark.createDataFrame(right, "k long, v string")
    assert Counter(map(tuple, skew_join(a, b, ["k"]).collect())) == Counter((k, i, v) for k, i in left for q, v in right if q == k)


def test_numbered_copies(spark):
    rows = [("a", 0), ("b", 1), ("c", 10), ("d", 11), ("e", 95)]
    got = numbered_copies(spark.createDataFrame(rows, "x string, n long"), "n", "at", 10).collect()
    assert Counter((r.x, r.at) for r in got) == Counter((x, i) for x, n in rows for i in range(n))


@pytest.mark.parametrize("hot", [1, 64])
def test_star_of_many(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    edges = [(0 if i % 2 else 900, i) for i in range(1, 800)] + [(900, 901), (1000, 1001), (1001, 1002), (950, 1002)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {0: 0, **{i: 0 for i in range(1, 800) if i % 2}, **{i: 2 for i in [*range(2, 800, 2), 900, 901]}, **{i: 950 for i in (950, 1000, 1001, 1002)}}


def test_placement_equals_brute_force(spark):
    rows = hot_docs()
    df = frame(spark, rows)
    shards = 24
    place = df.select("doc_id", F.col("text"), sharding.place(F.col("doc_id"), F.crc32(F.col("text").cast("binary"))).alias("p")).collect()
    ring = sharding.ring(spark, shards)
    arcs = defaultdict(list)
    for r in place:
        at = next((i for i, (p, _) in enumerate(ring) if p >= r.p), 0)
        arcs[at].append((r.p, r.doc_id is not None, r.doc_id or 0, zlib.crc32(r.text.encode()), len(r.text.encode()) + 8))
    room = [len(rows) // shards + (s < len(rows) % shards) for s in range(shards)]
    used, want, hop = [0] * shards, Counter(), 0
    left = {a: sorted(v) for a, v in sorted(arcs.items())}
    while left:  # a round offers what is left of each arc to the next virtual node clockwise
        for a in list(left):
            s = ring[(a + hop) % len(ring)][1]
            while left[a] and used[s] < room[s]:
                _, known, doc_id, crc, size = left[a].pop(0)
                want[(doc_id if known else None, size, crc, s, used[s])] += 1
                used[s] += 1
            if not left[a]:
                del left[a]
        hop += 1
    got = Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in sharding.assign_shards(df, shards).collect())
    assert got == want


def test_mix_of_hot_ids(spark):
    rows = [(i, t, f"s{n % 2}") for n, (i, t) in enumerate(hot_docs())]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix_sources(df).collect()
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert len(got) == len(rows) and all(abs(taken[s] - goal[s]) <= 0.5 for s in goal)
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    stored = materialize(df.withColumns({"__x": F.lit(1), "size": F.lit(2)}), "mixed")
    mixed = mixing.mixed_documents(stored)
    assert mixed.columns == stored.columns and mixing.mixed_documents(stored.limit(0)).count() == 0
    times = defaultdict(lambda: [0, 0])
    for r in got:
        times[r.doc_id][0] += r.taken
        times[r.doc_id][1] += r.size
    want = Counter()
    for i, t, s in rows:
        a, b = times[i]
        want[(i, t, s)] += int(np.floor(a / b + 0.5)) if b else 1
    assert Counter((r.doc_id, r.text, r.source) for r in mixed.collect()) == +want


def test_cut_cells_and_bands(spark, monkeypatch):
    """Groups of near copies too large for a block, whose sizes span several bands."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 100)
    r = random.Random(2)
    words = [f"w{r.randrange(4000)}" for _ in range(400)]
    rows = []
    for i in range(220):  # prefixes of one text: neighbours in size are linked, far ones aren't
        n = 60 + i
        rows.append((i, " ".join(words[:n])))
    rows += [(1000 + i, " ".join([*words[:200], f"x{i}"])) for i in range(120)]
    df = frame(spark, rows)
    got = {q.doc_id: q for q in ngram_join.jaccard_join(df, 4, 85).collect()}
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    links = {i: sum(j != i and 100 * len(s & q) >= 85 * len(s | q) for j, q in sets.items()) for i, s in sets.items()}
    assert {i: q.n_links for i, q in got.items()} == links
    assert {q.component_id for q in got.values()} == {0}
    step = np.log(100 / 85) * 1.000001
    assert len({int(np.log(len(s)) // step) for s in sets.values()}) > 6


def test_components_of_large_cells(spark, monkeypatch):
    """Without counts, cut cells of near copies, loners and small groups have the components that all pairs give."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 20)
    r = random.Random(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(240):  # one group of near copies, through a chain in part
        t = list(base)
        for _ in range(r.randrange(0, 4)):
            t[r.randrange(120)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(t)))
    for i in range(60):  # share first shingles with the group, but are linked with few or none
        rows.append((1000 + i, " ".join([*base[: r.randrange(40, 100)], *[f"y{i // 3}_{j}" for j in range(60)]])))
    df = frame(spark, rows)
    sets = {i: {tuple(t.split()[j : j + 4]) for j in range(len(t.split()) - 3)} for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, s in sets.items():
        for j, q in sets.items():
            if j < i and 100 * len(s & q) >= 85 * len(s | q):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = ngram_join.jaccard_join(df, 4, 85, count_links=False)
    assert "n_links" not in got.columns
    got = {q.doc_id: q.component_id for q in got.collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) > 10


def test_far_sizes_make_no_cell(spark, monkeypatch):
    """Texts that share first shingles but differ too much in size to be linked aren't compared; nor do they bring linked ones into one cell."""
    seen, check = [], ngram_join._check
    monkeypatch.setattr(ngram_join, "_check", lambda docs, members, *rest: seen.append(members.select("rep", "cell").collect()) or check(docs, members, *rest))
    words = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(words[: int(40 * 1.5**i)])) for i in range(12)]
    rows += [(100 + i, " ".join([*t.split()[:-1], f"z{i}"])) for i, t in rows[::5]]
    got = {q.doc_id: (q.component_id, q.n_links) for q in ngram_join.jaccard_join(frame(spark, rows), 4, 85).collect()}
    assert got == {i: (i % 100, int(i % 5 == 0 or i >= 100)) for i, _ in rows}
    (members,) = seen
    cells = Counter(m.cell for m in members)
    assert {m.rep for m in members} >= {0, 5, 10, 100, 105, 110} and max(cells.values()) == 2, cells


def test_connected_units_do_not_meet(spark):
    """A connected group of 50 units meets the 2 units of the others, in its band and the next, and never itself."""
    groups = spark.createDataFrame([(1, 0, "7", 50), (1, 0, "", 2), (1, 1, "7", 3), (1, 2, "", 1), (2, 0, "", 1)], "cell long, band int, g string, blocks int")
    tiles = [(t.unit, t.unit2) for t in ngram_join._tiles(groups).collect()]
    assert len(tiles) == len(set(tiles)) == 50 * 2 + 3 + 2 * 3 + 3 * 1 + 1 + 1
    assert not any("/7/" in a and "/7/" in b for a, b in tiles)


def test_band_step_holds_exact_ratios():
    """Sets whose sizes are at the very threshold are in one band or the next."""
    for num, den in ((85, 100), (80, 100)):
        step = np.log(den / num) * 1.000001
        n = np.arange(1, 300_000) * (num if num == 85 else 4)
        m = np.arange(1, 300_000) * (den if num == 85 else 5)
        a, b = np.floor(np.log(n) / step), np.floor(np.log(m) / step)
        assert ((b - a) <= 1).all()


def test_linked_pairs_equal_brute_force():
    r = np.random.RandomState(3)
    for num in (85, 80, 50):
        base = r.randint(0, 1 << 62, (6, 90)).astype(np.uint64)
        sets = []
        for i in range(150):
            b = base[i % 6]
            keep = b[r.rand(90) < r.uniform(0.6, 1)]
            sets.append(np.unique(np.concatenate([keep, r.randint(0, 1 << 62, r.randint(1, 8)).astype(np.uint64)])))
        sides = r.randint(0, 2, len(sets))
        for of in (None, sides):
            a, b = ngram_join.linked_pairs(sets, num, 100, of)
            want = set()
            for i, x in enumerate(sets):
                for j in range(i):
                    both = len(np.intersect1d(x, sets[j]))
                    if 100 * both >= num * (len(x) + len(sets[j]) - both) and (of is None or of[i] != of[j]):
                        want.add((j, i))
            assert {(min(p), max(p)) for p in zip(a.tolist(), b.tolist(), strict=True)} == want and len(a) == len(want)


def test_token_files_of_hot_ids(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 400)
    df = materialize(frame(spark, hot_docs()), "docs")
    path = shared_path(spark, "hot")
    token_files.write_tokens(df, path, public_tokenizers.path("word_bpe_49k.json"))
    back = token_files.read_tokens(spark, path)
    sizes = [r["count"] for r in back.groupBy("part").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 400  # neither the hot id nor null is one part
    rows = token_files.digests(back).orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted([i for i, _ in hot_docs()], key=lambda i: (i is not None, i or 0))
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows[:-1])]).tolist()
    empty = shared_path(spark, "none")
    token_files.write_tokens(df.limit(0), empty, public_tokenizers.path("word_bpe_49k.json"))
    assert token_files.read_tokens(spark, empty).count() == 0 and token_files.digests(token_files.read_tokens(spark, empty)).count() == 0


def test_orc_metadata_prunes(spark, monkeypatch, tmp_path):
    """A filter on doc_id reads one group of 1000 rows by its statistics, and none if the Bloom filter lacks the id."""
    monkeypatch.setitem(token_files.OPTIONS, "orc.stripe.size", "65536")
    r = random.Random(4)
    df = spark.createDataFrame([(i * 3, " ".join(f"w{r.randrange(10**6)}" for _ in range(60))) for i in range(6000)], "doc_id long, text string")
    path = f"{tmp_path}/t"
    token_files.write_tokens(df.coalesce(1), path, public_tokenizers.path("word_bpe_49k.json"))

    def rows_read(doc_id):
        q = spark.read.schema(token_files.SCHEMA).orc(path).where(F.col("doc_id") == doc_id).select("doc_id", "n_tokens")
        found = len(q.collect())
        return found, q._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    found, read = rows_read(9000)
    assert found == 1 and 1 <= read <= 1000
    missing = [rows_read(9000 + 3 * i + 1) for i in range(12)]  # between the ids of a group
    assert all(f == 0 for f, _ in missing) and sum(n == 0 for _, n in missing) >= 10


def test_other_vocabularies_get_whole_texts(spark):
    from tokenizers import Tokenizer

    assert token_files.parts_words(public_tokenizers.path("word_bpe_49k.json"))
    name = public_tokenizers.path("byte_bpe_50k.json")
    assert not token_files.parts_words(name)
    texts = ["Hello  World\n it's", "", "a b", "<|endoftext|> Éa"]
    encode = Tokenizer.from_file(name).encode
    assert [x.tolist() for x in token_files.Encoder(name).encode(texts)] == [[*encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_many_languages(spark, monkeypatch):
    assert [langid.shift_for(n) for n in (0, 1, 128, 129, 8000, 10**9)] == [0, 0, 0, 1, 6, 14]
    monkeypatch.setattr(langid, "ENTRIES", 1 << 16)
    r = random.Random(3)
    names = [f"l{i:03d}" for i in range(40)]
    own = {n: ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(6)] for n in names}
    rows = [(n, " ".join(r.choice(own[n]) for _ in range(40))) for n in names for _ in range(3)]
    train = spark.createDataFrame(rows, "lang string, text string")
    model = langid.learn(train)
    assert model.shift == 6 and model.log_p.size <= 1 << 16
    docs = spark.createDataFrame([(i, " ".join(own[n])) for i, n in enumerate(names)], "doc_id long, text string")
    got = {g.doc_id: g.lang_pred for g in langid.identify(docs, train).collect()}
    assert np.mean([got[i] == n for i, n in enumerate(names)]) > 0.9


def test_join_leaves_no_shuffle_files(spark):
    """Once a table of the join is written its shuffle files and token lists go; texts without a candidate aren't shuffled."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles().toList()
        found = {f.getName(): f.length() for f in (files.apply(i) for i in range(files.size()))}
        return {name: size for name, size in found.items() if name.startswith("shuffle_")}

    texts = [" ".join(f"w{i}x{j}" for j in range(400)) for i in range(300)]
    df = materialize(frame(spark, [*enumerate(texts), (900, texts[7] + " end"), (901, texts[8]), (902, texts[8])]), "docs")
    old, written = set(shuffled()), len(common._written)
    got = ngram_join.jaccard_join(df, 5, 80)
    left = sum(size for name, size in shuffled().items() if name not in old)
    assert left < sum(map(len, texts)) / 20, left
    assert not [p for p in common._written[written:] if "/sets-" in p or "/shared-" in p]
    linked = {r.doc_id: (r.component_id, r.n_links) for r in got.collect() if r.n_links}
    assert linked == {7: (7, 1), 900: (7, 1), 8: (8, 2), 901: (8, 2), 902: (8, 2)}


def test_join_beyond_broadcasts(spark, monkeypatch):
    """With too many copies or candidates to broadcast, the join shuffles and finds the same."""
    rows = [(i, f"{'a b c d e f g h i j k l m n o p ' * 3}{i // 3 * 'x '}") for i in range(30)] + [(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f")]
    few = sorted(map(str, ngram_join.jaccard_join(frame(spark, rows), 4, 85).collect()))
    monkeypatch.setattr(ngram_join, "FEW", -1)
    assert few == sorted(map(str, ngram_join.jaccard_join(frame(spark, rows), 4, 85).collect()))
