"""Identifiers written with spaces are found by their context."""

from sigspark.llm import pii


def spans(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: [s for s in r.spans.split(",") if s] for r in pii.personal_data(docs).collect()}


def span(kind, text, value):
    at = text.index(value)
    return f"{kind}:{at}:{at + len(value)}"


def luhn(body):
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def test_spaced_numbers(spark):
    phones = [f"call hotline +1 523 555 {1000 + i} today" for i in range(30)]
    cards = [" ".join([c[:4], c[4:8], c[8:12], c[12:]]) for c in (luhn(f"41111111111{1000 + i}") for i in range(30))]
    wrong = f"{cards[0][:-1]}{(int(cards[0][-1]) + 1) % 10}"
    texts = phones + [f"paid with card {c} yesterday" for c in cards]
    found = ["523 555 2222", "(523) 555-3333", "523.555 4444", "523 - 555 - 5555", "(523) 555 6666"]
    odd = [("phone", f"please call hotline {v} today.", v) for v in found]
    odd += [("card", f"paid with card {wrong} yesterday", wrong), ("phone", "call hotline 5235557777 today", "5235557777")]
    plain = ["in 2019 about 523 555 2222 people", "rows 1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20", "call hotline 52 today"]
    got = spans(spark, texts + [t for _, t, _ in odd] + plain)
    for i, (kind, text, value) in enumerate(odd, len(texts)):
        assert got[i] == [span(kind, text, value)], text
    for i in range(len(texts) + len(odd), len(got)):
        assert got[i] == []


def test_context_is_of_the_text(spark):
    texts = [f"ticket {i}x hotline +1 523 555 {1000 + i} today" for i in range(30)]
    beside = ["call 77 hotline 5235557777 today 88", "x" * 63 + "\U0001f600 hotline 5235558888 today"]
    got = spans(spark, texts + beside)
    for i, text in enumerate(beside, len(texts)):
        assert span("phone", text, text.split("hotline ")[1].split(" ")[0]) in got[i]


def test_scores_equal_brute_force(spark):
    """Confidences, scores and spans of ``discover`` against loops over dictionaries."""
    import math
    import random
    import re
    from collections import defaultdict

    from sigspark.llm.common import materialize

    r = random.Random(5)
    patterns = [f"p{i} _" for i in range(12)]
    rows = []
    for i in range(900):
        p = r.randrange(12)
        seed = r.random() < (0.97, 0.95, 0.9, 0.6, 0.5, 0.3)[p % 6]
        n = r.randrange(60)
        inst, kind = (f"+1523555{1000 + n}", "phone") if seed else (f"523555{2000 + n}" if r.random() < 0.9 else f"x{n}@", None)
        if seed and p % 6 > 1 and r.random() < 0.2:
            inst, kind = f"m{n}@example.org", "email"
        at = r.randrange(50)
        rows.append((r.choice([None, *range(200)]), i, kind, at, at + len(inst), inst, [patterns[p], patterns[(p + 6) % 12]], r.random() < 0.95))
    rows += [(7, 1000, None, 3, 13, "5235559999", [patterns[0]] * 2, True)] * 450  # one pattern in a third of all rows
    schema = "doc_id long, h long, kind string, start long, end long, inst string, patterns array<string>, whole boolean"
    got = set(map(tuple, pii.discover(materialize(spark.createDataFrame(rows, schema), "o")).collect()))

    insts, seeds, open_ = defaultdict(set), defaultdict(float), defaultdict(set)
    for _, _, kind, _, _, inst, ps, whole in rows:
        for p in ps:
            if whole:
                insts[p].add(inst)
                if kind:
                    seeds[inst, kind] = 1.0
            if kind is None:
                open_[inst].add(p)
    # An edge is whole if any of its mentions is.
    scores = dict(seeds)
    for _ in range(pii.ROUNDS):
        sure = {}
        for p, members in insts.items():
            if len(members) >= pii.SUPPORT:
                for k in pii.KINDS:
                    c = sum(scores.get((i, k), 0.0) for i in members) / len(members)
                    if c >= pii.PASSES:
                        sure[p, k] = c
        new = {}
        for inst, ps in open_.items():
            for k in pii.KINDS:
                of = [sure[p, k] for p in ps if (p, k) in sure]
                if of:
                    new[inst, k] = 1 - math.exp(sum(math.log(1 - min(c, 0.999)) for c in of))
        scores = {key: max(seeds.get(key, 0.0), new.get(key, 0.0)) for key in {*seeds, *new}}
    want = set()
    for doc, h, kind, start, end, inst, ps, _ in rows:
        for k in pii.KINDS:
            if kind is None and scores.get((inst, k), 0) >= pii.SCORE and any(sure.get((p, k), 0) >= pii.SURE for p in ps) and re.search(pii.FORMS[k], inst):
                want.add((doc, h, k, start, end))
    assert got == want and len(want) > 8


def test_discovery_adds_spans(spark):
    """In text with contexts: what discovery adds to the base spans, and nothing where there is no context."""
    import random

    r = random.Random(9)
    filler = lambda: " ".join(r.choice(["river", "stone", "amber", "cloud", "field"]) for _ in range(8))
    number = lambda: "".join(r.choice("0123456789") for _ in range(10))
    contexts = [("call hotline", "today"), ("phone number is", "please")]
    texts, hidden, plain = [], [], []
    for i in range(300):
        a, b = contexts[i % 2]
        n = number()
        if i % 3:
            texts.append(f"{filler()} {a} +1{n} {b} {filler()}")
        else:
            texts.append(f"{filler()} {a} {n} {b} {filler()}")
            hidden.append((i, n))
    for i in range(100):
        plain.append(len(texts))
        texts.append(f"{filler()} counted {number()} {filler()}")
    got = spans(spark, texts)
    found = sum(span("phone", texts[i], n) in got[i] for i, n in hidden)
    assert found / len(hidden) >= 0.95 and not any(got[i] for i in plain)
