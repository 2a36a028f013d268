"""Each operator against brute force, an exact round trip or held-out accuracy, and on odd input."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sigspark.llm import ann, chat, components, decontaminate, langid, mixing, ngram_join, pii, sharding, token_files, toxicity
from sigspark.llm.common import shared_path
from sigspark.llm.components import connected_components

#: Nulls, empty and blank texts, repeats, one word, a very long text.
ODD = [(-1, None), (-2, ""), (-3, " \n\t "), (-4, "one"), (-5, "Same text here."), (-6, "Same text here."), (None, "no id at all"), (-7, "long words " * 30_000), (-8, "İstanbul é \U0001f600 123")]
SCHEMA = "doc_id long, text string"


def words(n, seed, size=400):
    r = random.Random(seed)
    return [f"w{r.randrange(size)}" for _ in range(n)]


def corpus():
    rows = []
    for i in range(40):
        base = words(60, i, 5000)
        rows.append(" ".join(base))
        for j in range(i % 4):
            copy = list(base)
            for _ in range(j + 1):
                copy[random.Random(i * 9 + j).randrange(60)] = f"x{i}{j}"
            rows.append(" ".join(copy).upper() if j % 2 else " ".join(copy))
    passage = " ".join(words(30, 999, 5000))
    rows += [passage + " " + " ".join(words(25, 500 + i, 9000)) for i in range(30)] + [rows[0]] * 5
    return list(enumerate(rows))


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA)
    # Columns whose names clash with those that operators add.
    return df.withColumns({c: F.lit("x") for c in ("h", "key", "tokens", "rep", "n", "size", "shard", "taken", "score", "w")}) if extra else df


def sets(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


@pytest.mark.parametrize("k,num", [(4, 85), (5, 80)])
def test_join_equals_brute_force(spark, k, num, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", 3)  # tiles of several blocks and bands
    rows = corpus() + [r for r in ODD if r[0] is not None]
    got = {r.doc_id: r for r in ngram_join.jaccard_join(docs(spark, rows), k, num).collect()}
    s = {i: sets(t, k) for i, t in rows}
    near = {i: {j for j in s if j != i and s[i] and s[j] and 100 * len(s[i] & s[j]) >= num * len(s[i] | s[j])} for i in s}
    for i in s:
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert (got[i].n_shingles, got[i].n_links, got[i].component_id) == (len(s[i]), len(near[i]), min(seen)), i
    assert sum(map(len, near.values())) > 50


def test_join_on_odd_rows(spark):
    got = ngram_join.jaccard_join(docs(spark, [*ODD, (-4, "one"), (-4, "other words")])).collect()
    assert len(got) == len(ODD) + 2
    assert next(r for r in got if r.doc_id is None).component_id is None
    assert ngram_join.jaccard_join(docs(spark, []).limit(0)).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    root = {v: v for e in edges for v in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    linked = {v for a, b in edges if a != b for v in (a, b)}
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {v: find(v) for v in linked}


def test_few_edges_take_one_task(spark, monkeypatch):
    """Few edges are solved in few jobs; rounds over all tasks find the same."""
    r = random.Random(8)
    edges = spark.createDataFrame([(r.randrange(500) - 250, r.randrange(500) - 250) for _ in range(350)] + [(2000 + i, 2001 + i) for i in range(60)], "a long, b long")
    sc = spark.sparkContext
    sc.setJobGroup("few", "")
    try:
        got = dict(map(tuple, connected_components(edges).collect()))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("few")) <= 6
    monkeypatch.setattr(components, "IN_ONE_TASK", 0)
    assert got == dict(map(tuple, connected_components(edges).collect())) and len(set(got.values())) > 20
    assert connected_components(edges.limit(0)).count() == 0


def test_chat(spark):
    odd = "a\\|b\\\\<\\|x|>\n<|im_end|>\n<|im_start|>user"
    rows = [(-1, 0, "user", odd), (-1, 1, "assistant", odd), (-2, 0, None, None), (-3, 0, "assistant", ""), (-3, 1, "ro\nle<|nl|>", "t"), (-4, None, "assistant", "b"), (-4, None, "assistant", "a"), (-4, None, "assistant", "a"), (None, 1, "assistant", "z"), (-5, 0, "assistant", "x" * 50_000)]
    rows += [(i, t, ("system", "user", "assistant")[t % 3], f"turn {t} of {i} é<|") for i in range(20) for t in range(i)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit(1)).withColumn("formatted", F.lit(2))
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.digests(formatted).collect()}
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said, loss = "".join(f"{a}\n{b}\n" for _, a, b in turns), "".join(b for _, a, b in turns if a == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for r in chat.expand_examples(formatted).where("conv_id = 8").collect():
        assert r.context.count("<|im_start|>") == r.turn + 1 and r.context.endswith("assistant\n")
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_chat_digests_read_examples(spark, monkeypatch):
    """Losses and contexts come from one row for each target turn, without the conversation in each of them."""
    texts = ["a<|b", "", "é\n\\|", "<|im_start|>assistant"]
    rows = [(c, t, "assistant" if (t + c) % 2 else "user", texts[(c + t) % 4]) for c in range(6) for t in range(c)] + [(None, 0, "assistant", "z"), (9, 0, "user", "only")]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = sorted((str(c), t, text) for c, t, role, text in rows if role == "assistant")
    found = chat.expand_examples(formatted).withColumn("said", chat.unescape(F.col("reply"))).collect()
    assert sorted((str(r.conv_id), r.turn, r.said) for r in found) == want
    whole = {r.conv_id: r.formatted for r in formatted.collect()}
    assert all(r.context_chars == len(r.context) and whole[r.conv_id].startswith(r.context + r.reply + "<|im_end|>") for r in found)
    made, expand = [], chat.expand_examples
    monkeypatch.setattr(chat, "expand_examples", lambda *a, **b: made.append(expand(*a, **b)) or made[-1])
    got = {r.conv_id: (r.n_examples, r.context_chars) for r in chat.digests(formatted).collect()}
    assert got == {c: (sum(r.conv_id == c for r in found), sum(r.context_chars for r in found if r.conv_id == c)) for c in whole} and got[9] == (0, 0)
    assert len(made) == 1 and made[0].where("example IS NOT NULL").count() == len(want)
    plan = chat.digests(formatted)._jdf.queryExecution().optimizedPlan().toString()
    generate = next(line for line in plan.splitlines() if "Generate" in line)
    assert "posexplode" in generate and "formatted" not in generate and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(int(c) * (1 + i % 2) - 9 * (int(c) * (1 + i % 2) > 9) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or max(map(int, m[0].split("."))) <= 255, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab1234567890.@+- ()é\n_%") for _ in range(300)) for _ in range(300)]
    texts += ["a@b.c+d@e.f x@y@z.w 1.2.3.4.5.6.7.8 001.2.3.255 +1 (523) 555-1055 é 4111 1111 1111 1111-", "9" * 20_000 + " " + "a" * 20_000 + "@", "1.1.1.1 " * 700]
    rows = [*ODD, *enumerate(texts), (3, texts[3])]
    got = pii.personal_data(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, ",".join(base_spans(t)), hashlib.sha256(",".join(base_spans(t)).encode()).hexdigest()) for i, t in rows)
    assert Counter((g.doc_id, g.base_sha256) for g in got) == Counter({(i, h): n for (i, _, h), n in want.items()})
    assert pii.personal_data(docs(spark, rows).limit(0)).count() == 0


def test_pii_discovers_by_context(spark):
    rows = [(i, f"item {i} please call hotline +1 (523) 555-{1000 + i} today thanks") for i in range(12)]
    rows += [(100, "now please call hotline 5235552222 today thanks"), (101, "we counted 5235553333 grains of sand")]
    got = {r.doc_id: r for r in pii.personal_data(docs(spark, rows)).collect()}
    at = rows[12][1].index("5235552222")
    assert got[100].spans == f"phone:{at}:{at + 10}" and got[100].n_phone == 0
    assert got[101].spans == "" and got[3].spans.count("phone") == 1


def test_sharding(spark):
    rows = [*ODD, *((i, f"t{i}") for i in range(1000)), (5, "again")]
    got = sharding.assign_shards(docs(spark, rows), 24).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 24 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    texts = dict(rows)
    assert all(r.size == len((texts[r.doc_id] or "").encode()) + 8 and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode()) for r in got if r.doc_id != 5)
    more = {r.doc_id: r.shard for r in sharding.assign_shards(docs(spark, rows), 25).collect()}
    assert np.mean([more[r.doc_id] == r.shard for r in got]) > 0.5  # limited movement
    assert sharding.assign_shards(docs(spark, rows).limit(0), 24).count() == 0


def test_ring_overflow_goes_clockwise():
    out = sharding.pass_on([5, 0, 1, 0], [0, 1, 2, 1], 3)
    assert out == [(0, 0, 2, 0, 0), (2, 0, 1, 2, 0), (0, 2, 4, 1, 0), (0, 4, 5, 2, 1)]
    r = random.Random(1)
    owners = [r.randrange(6) for _ in range(60)]
    counts = [r.randrange(20) for _ in range(60)]
    out = sharding.pass_on(counts, [*range(6), *owners[6:]], 6)
    held = Counter()
    for _, a, b, s, base in out:
        assert base == held[s]
        held[s] += b - a
    assert max(held.values()) - min(held.values()) <= 1 and sum(held.values()) == sum(counts)


def test_mixing(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 40)), f"s{i % 5}" if i % 5 else None) for i in range(400)] + [(i, t, "odd") for i, t in ODD] + [(1, "w w", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(0)).withColumn("key", F.lit(0))
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix_sources(df).collect()), key=str)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    names = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, capped = {}, set()
    while True:
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[t] for t in names if t not in capped) for s in names if s not in capped}
        over = {s for s in share if share[s] > 3 * sizes[s]}
        if not over:
            target = share | {s: 3 * sizes[s] for s in capped}
            break
        capped |= over
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in names)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and mixed.where("doc_id = -3").count() == 1
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_decontamination(spark):
    items = [(i, " ".join(words(12 + i % 30, 7000 + i, 9000))) for i in range(30)] + [(90, "two words"), (91, None), (92, ""), (93, "Same, text: HERE")]
    rows = list(ODD)
    for i, t in items[:30]:
        w = t.split()
        rows.append((1000 + i, " ".join(words(300, i) + w + words(300, i + 1))))
        rows.append((2000 + i, " ".join(words(50, i) + w[: len(w) // 2] + words(50, i))))
        rows.append((3000 + i, " ".join([*words(50, i), *w[:-1], "changed"]).upper().replace(" ", ", ")))
    rows.append((4000, "has two words in it"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n", F.lit(1))

    def grams(t, k):
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}, len(w)

    want = set()
    for i, t in items:
        n = grams(t, 1)[1]
        k = min(5, n)
        if n:
            s = grams(t, k)[0]
            want |= {(d, i, len(s), len(s & grams(x, k)[0])) for d, x in rows if len(s & grams(x, k)[0]) * 100 >= 80 * len(s)}
    got = set(map(tuple, decontaminate.contained_items(docs(spark, rows), bench).collect()))
    assert got == want and len(want) > 40
    assert decontaminate.contained_items(docs(spark, rows), bench.limit(0)).count() == 0
    assert decontaminate.contained_items(docs(spark, rows).limit(0), bench).count() == 0


def test_token_files(spark):
    r = random.Random(2)
    texts = ["".join(r.choice(["It's ", "don't", "a.", ",b", "x..", " ", "\n", " ", "Été", "12", "ΣΣ ", "<|endoftext|>", "<|ENDOFTEXT|>", "é", "word. ", "Word, ", "中文"]) for _ in range(60)) for _ in range(200)]
    rows = [*ODD, *enumerate(texts)]
    path, vocabulary = shared_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json")
    token_files.write_tokens(docs(spark, rows), path, vocabulary)
    got = token_files.digests(token_files.read_tokens(spark, path)).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(vocabulary).encode
    start = 0
    for g, (i, t) in zip(got, sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = np.array([*encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes())), t
        start += len(ids)
    part = token_files.read_tokens(spark, path).where("doc_id = 7")
    assert part.count() == 1
    token_files.write_tokens(docs(spark, rows).limit(0), shared_path(spark, "e"), vocabulary)


def test_neighbours_recall(spark):
    r = np.random.RandomState(5)
    x = np.vstack([r.randn(1500, 16), r.randn(1, 16) + 0.01 * r.randn(300, 16)]) * r.rand(1800, 1)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000 + i, x[0].tolist()) for i in range(60)]
    odd = [(9000, None), (9020, [0.0] * 16), (9040, [None] * 16), (9060, [float("nan")] * 16), (9080, []), (None, [1.0] * 16), (9100, [1.0, 2.0]), (9120, [3.0, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    got = defaultdict(list)
    for g in ann.neighbours(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[g.query_id].append((g.rank, g.vec_id, g.score))
    ids, v = np.array([i for i, _ in rows]), np.array([e for _, e in rows])
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        best = np.lexsort((ids, -s))[:20]
        hits += len(set(ids[best]) & {m for _, m, _ in got[q]})
        total += 20
        assert [k for k, _, _ in got[q]] == list(range(1, 21)) and all(abs(c - v[ids == m][0] @ v[ids == q][0]) < 1e-9 for _, m, c in got[q])
        assert [(-c, m) for _, m, c in got[q]] == sorted((-c, m) for _, m, c in got[q])
    assert hits / total >= 0.9
    assert got[9100] == [(1, 9120, 5.0)] and not {9000, 9020, 9040, 9060, 9080} & set(got)
    assert ann.neighbours(df.limit(0), df.limit(0)).count() == 0


def test_toxicity_held_out(spark):
    r = random.Random(6)
    stems = ["blarg", "snurf"]
    rows, marks = [], []
    for i in range(600):
        w = ["".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8))) for _ in range(40)]
        toxic = int(i % 5 == 0)
        if toxic:
            w[r.randrange(40)] = r.choice(stems) + "".join(r.choice("aei") for _ in range(2))
        rows.append((i, " ".join(w)))
        marks.append((i, toxic))
    marks += [(1, None), (None, 1), (2, 7), (3, 0)]
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    got = toxicity.toxicity(docs(spark, rows + ODD), labels).collect()
    assert len(got) == len(rows) + len(ODD)
    for g in got:
        assert 0 <= g.score <= 1 and g.predicted == int(g.score >= 0.5)
        assert g.held_out == (g.doc_id is not None and zlib.crc32(str(g.doc_id).encode()) % 5 == 0)
    held = [g for g in got if g.held_out and g.doc_id >= 0]
    assert np.mean([g.predicted == int(g.doc_id % 5 == 0) for g in held]) > 0.9
    none = toxicity.toxicity(docs(spark, ODD), labels.limit(0)).collect()
    assert all(g.score == 0.5 for g in none)
    assert toxicity.toxicity(docs(spark, ODD).limit(0), labels).count() == 0


def test_language_spans(spark):
    r = random.Random(8)
    syllables = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["krz", "sch", "ung", "eit"], "cc": ["пр", "ив", "ет"]}
    say = lambda lang, n: " ".join("".join(r.choice(syllables[lang]) for _ in range(3)) for _ in range(n))
    train = spark.createDataFrame([(lang, say(lang, 60)) for lang in syllables for _ in range(20)] + [(None, "x"), ("aa", None)], "lang string, text string")
    a, b = say("aa", 30), say("bb", 20)
    rows = [(1, say("aa", 10)), (2, say("bb", 10)), (3, say("cc", 1)), (4, a + " " + b), (5, "123 !"), *ODD]
    got = {g.doc_id: g for g in langid.identify(docs(spark, rows), train).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 5, -1, -2, -3)] == ["aa", "bb", "cc", "und", "und", "und", "und"]
    assert [(s.start, s.end, s.lang) for s in got[4].spans] == [(0, len(a), "aa"), (len(a) + 1, len(a) + 1 + len(b), "bb")]
    assert all(0 <= g.score <= 1 for g in got.values()) and len(got) == len(rows)
    kept = langid.accept(docs(spark, rows), train)
    assert kept.columns == docs(spark, rows).columns and {5, -1, -2, -3}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.identify(docs(spark, rows).limit(0), train).count() == 0
    assert {g.lang_pred for g in langid.identify(docs(spark, rows), train.limit(0)).collect()} == {"und"}


def test_viterbi_is_the_best_path():
    r = np.random.RandomState(9)
    for _ in range(20):
        n = r.randint(1, 7)
        scores = -r.rand(n, 3) * 10
        text = np.zeros(n, int)
        got = langid.viterbi(scores, text, 2.5)
        value = lambda p: sum(scores[i, s] for i, s in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = max(value(p) for p in np.ndindex(*[3] * n))
        assert abs(value(got) - best) < 1e-9
