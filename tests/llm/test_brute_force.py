"""Models and permutations of the corpus operators against plain Python that follows their definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from datetime import date, timedelta

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabulith.llm import mixing, pii, toxicity


# 5: mixing

def plain_evidence(text):
    """Words and marks of style, by their buckets."""
    text = text or ""
    words = [w for w in re.split("[\x00-/:-@\\[-`{-\x7f]+", text.lower()) if w]
    length, size, lines = max(len(text), 1), max(len(words), 1), text.split("\n")
    signs = max(length - len(" ".join(words)), 0)
    log2 = lambda n: math.floor(math.log2(n))
    marks = [
        f"signs{min(signs * 40 // length, 12)}", f"capitals{min(len(re.findall('[A-Z]', text)) * 20 // length, 12)}",
        f"words{log2(size)}/{len(set(words)) * 10 // size}", f"lines{log2(len(lines))}/{len(set(lines)) * 10 // len(lines)}",
    ]

    def bucket(word, n):
        return xxhash.xxh64_intdigest(word.encode(), seed=42) % n

    return len(words), [bucket(w, mixing.BUCKETS) for w in words], [mixing.BUCKETS + bucket("\x00" + m, mixing.STYLES) for m in marks]


def plain_memberships(texts, labels, domains):
    known = {}
    for i, (quality, toxic) in labels.items():
        if zlib_fold(i):
            known[i] = "toxic" if toxic == 1 else "good" if quality == 1 else "low"
    counts = {d: Counter() for d in domains}
    for i, d in known.items():
        _, words, marks = plain_evidence(texts[i])
        counts[d].update(words + marks)
    sizes = Counter(known.values())
    n = len(known)
    totals = {d: sum(v for k, v in counts[d].items() if k < mixing.BUCKETS) for d in domains}
    whole = sum(totals.values()) or 1
    out = {}
    for i, text in texts.items():
        tokens, words, marks = plain_evidence(text)
        logit = {}
        for d in domains:
            share = lambda k: sum(counts[x][k] for x in domains)
            seen = lambda k: share(k) > 0
            of_words = sum(math.log((counts[d][k] + mixing.SMOOTH * share(k) / whole) / (totals[d] + mixing.SMOOTH)) for k in words if seen(k))
            of_marks = sum(math.log((counts[d][k] + mixing.MARK_SMOOTH * share(k) / max(n, 1)) / (sizes[d] + mixing.MARK_SMOOTH)) for k in marks if seen(k))
            logit[d] = math.log((sizes[d] + 1) / (n + len(domains))) + min(tokens, mixing.WORDS) / max(tokens, 1) * of_words + of_marks
        top = max(logit.values())
        odds = {d: math.exp(x - top) for d, x in logit.items()}
        out[i] = tokens, {d: v / sum(odds.values()) for d, v in odds.items()}
    return out


def zlib_fold(i):
    import zlib

    return zlib.crc32(str(i).encode()) % 5


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    texts, labels = {0: None, 1: "", 2: "?! --", 3: "one"}, {}
    for i in range(4, 160):
        kind = i % 4
        vocabulary = [["calm", "river", "stone", "light"], ["BUY", "now!!", "cheap", "deal"], ["bad", "vile", "mean", "river"], ["light", "deal", "vile", "word"]][kind]
        texts[i] = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(3, 90))) + "\nend" * rng.randrange(3)
        if i % 3:
            labels[i] = int(kind == 0), int(kind == 2)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    marks = spark.createDataFrame([(i, q, t) for i, (q, t) in labels.items()], "doc_id long, quality int, toxic int")
    return texts, labels, docs, marks


def test_memberships_are_naive_bayes(spark, mixed):
    texts, labels, docs, marks = mixed
    domains = list(mixing.TARGETS)
    model, priors = mixing.train(docs, marks, domains)
    got = {r["doc_id"]: r for r in mixing.memberships(docs, model, priors).collect()}
    want = plain_memberships(texts, labels, domains)
    for i, (tokens, shares) in want.items():
        assert got[i]["tokens"] == tokens
        assert [got[i][f"p_{d}"] for d in domains] == pytest.approx([shares[d] for d in domains], abs=1e-9), i


def test_rates_are_the_nearest_that_meet_the_targets(mixed):
    """Where no rate falls to 0, the steps stay in 1 + span of memberships, where one point meets the targets."""
    texts, _, docs, marks = mixed
    own = mixing.mix(docs, marks, {"good": 1, "low": 1, "toxic": 1}).toPandas()
    p, tokens = own[["p_good", "p_low", "p_toxic"]].to_numpy(), own["tokens"].to_numpy()
    totals = tokens @ p
    targets = dict(zip(("good", "low", "toxic"), totals * [1.0, 0.9, 1.1] / (totals * [1.0, 0.9, 1.1]).sum()))
    rows = mixing.mix(docs, marks, targets).toPandas().sort_values("doc_id")
    p, tokens = rows[["p_good", "p_low", "p_toxic"]].to_numpy(), rows["tokens"].to_numpy()
    totals = tokens @ p
    share = np.array(list(targets.values()))
    wanted = share / share[0] * totals[0]
    weights = np.linalg.solve((p * tokens[:, None]).T @ p, wanted - totals)
    assert (1 + p @ weights > 0).all()
    assert rows["rate"].to_numpy() == pytest.approx(1 + p @ weights, abs=5e-3)


def test_missed_targets_are_told(mixed, monkeypatch):
    _, _, docs, marks = mixed
    monkeypatch.setattr(mixing, "STEPS", 1)
    with pytest.warns(UserWarning, match="still miss"):
        mixing.mix(docs, marks, {"good": 0.2, "low": 0.1, "toxic": 0.7}).count()


# 8: pseudonyms

def feistel(values, radices, tweak, key):
    half = len(values) // 2
    a, b, ra, rb = values[:half], values[half:], radices[:half], radices[half:]
    for r in range(1, pii.ROUNDS + 1):
        h = hashlib.sha512(f"{key}|{tweak}|{r}|{','.join(map(str, b))}".encode()).hexdigest()
        moved = [(x + int(h[i % 32 * 4 : i % 32 * 4 + 4], 16) + i // 32) % ra[i] for i, x in enumerate(a)]
        a, b, ra, rb = b, moved, rb, ra
    return a + b


def plain_text(text, kind, key):
    alphabets = ["0123456789abcdef"] if kind == "secret" else pii.ALPHABETS
    letters = [c for c in text if c.isalnum()]
    own = [next((a for a in alphabets if c in a), c) for c in letters]
    radices = [len(a) for a in own]
    new = feistel([a.index(c) for a, c in zip(own, letters)], radices, f"{kind}/{','.join(map(str, radices))}", key)
    made = iter(a[v] for a, v in zip(own, new))
    return "".join(next(made) if c.isalnum() else c for c in text)


def plain_date(text, key):
    day = date.fromisoformat(text)
    v = feistel(list(divmod((day - date(1900, 1, 1)).days, 286)), [256, 286], "date", key)
    return (date(1900, 1, 1) + timedelta(days=v[0] * 286 + v[1])).isoformat()


def pseudonyms(spark, texts, key="key"):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymise(rows, key).orderBy("doc_id").collect()]


def test_pseudonyms_are_a_feistel_network(spark):
    rng = random.Random(8)
    mails = ["é@x.com", "z@x.com", "Ünï.cödé-9@a.b.example", "日本a@x.com", "Анна.k@x.org"] + ["".join(rng.choice("ab.9Z_") for _ in range(9)) + "q@m.net" for _ in range(30)]
    mails = ["m" + m for m in mails]
    days = [(date(1900, 1, 1) + timedelta(days=rng.randrange(73000))).isoformat() for _ in range(40)]
    ips = [".".join(str(rng.randrange(256)) for _ in range(4)) for _ in range(40)]
    secrets = ["token = " + "".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(10)]
    want = [plain_text(m.split("@")[0], "email", "key") + "@" + m.split("@")[1] for m in mails] + [plain_date(d, "key") for d in days]
    want += [".".join(map(str, feistel(list(map(int, i.split("."))), [256] * 4, "ip", "key"))) for i in ips]
    want += ["token = " + plain_text(s[8:], "secret", "key") for s in secrets]
    assert pseudonyms(spark, mails + days + ips + secrets) == want


def test_pseudonyms_of_different_values_differ(spark):
    rng = random.Random(3)
    n = 10_000
    days = [date(1900, 1, 1) + timedelta(days=k * 7) for k in range(n)]
    letters = "aéàzßšα"
    digits = ["".join(rng.choice("0123456789") for _ in range(15)) for _ in range(n)]
    luhn = lambda d: str(-sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(d))) % 10)
    kinds = {
        "mail": ["".join(rng.choice(letters) for _ in range(9)) + "@x.com" for _ in range(n)],
        "slashes": [d.strftime("%m/%d/%Y") for d in days] + [d.strftime("%d/%m/%Y") for d in days if d.day > 12 and d.year < 2100],
        "dashes": [d.strftime("%d-%m-%Y") for d in days] + [d.strftime("%m-%d-%Y") for d in days if d.day > 12 and d.year < 2100],
        "card": [d + luhn(d) for d in digits], "phone": [f"+1 {200 + i % 700}-{100 + i % 900}-{i:04d}" for i in range(n)],
        "ssn": [f"{1 + i % 600:03d}-{1 + i % 99:02d}-{1 + i % 9999:04d}" for i in range(n)],
    }
    for kind, values in kinds.items():
        values = sorted(set(values))
        got = pseudonyms(spark, values)
        assert len(set(got)) == len(values), kind
        assert sum(a == b for a, b in zip(values, got)) < len(values) / 100, kind


def test_hostile_texts_end(spark):
    texts = ["a@" + "b." * 500_000, "1 " + "a" * 1_000_000, "1" * 1_000_000, "a.1@" * 250_000, "+1 " * 300_000, "DE89 " * 200_000]
    assert [len(t) for t in pseudonyms(spark, texts)[1:]] == [len(t) for t in texts[1:]]


# 9: toxicity

def plain_features(labelled, asked, d1, d2):
    """The formulas of the module's docstring, word by word."""
    pairs = [Counter(), Counter()]
    for words, toxic in labelled:
        pairs[toxic].update(zip([None, *words], words))
    cont = [Counter(w for _, w in c) for c in pairs]
    size, taken = [sum(c.values()) for c in cont], [sum(min(n, d1) for n in c.values()) for c in cont]
    back = lambda w: max(sum(min(c[w], d1) for c in cont), 1) / sum(taken)
    a = lambda c, w: max(cont[c][w] - d1, 0) / size[c] + taken[c] / size[c] * back(w)
    after = [Counter(), Counter()]
    lost = [Counter(), Counter()]
    pooled, lost_pooled = pairs[0] + pairs[1], Counter()
    for c in (0, 1):
        for (u, _), n in pairs[c].items():
            after[c][u] += n
            lost[c][u] += min(n, d2)
    for (u, _), n in pooled.items():
        lost_pooled[u] += min(n, d2)

    def odds(u, w):
        middle, n = (a(0, w) + a(1, w)) / 2, after[0][u] + after[1][u]
        shared = max(pooled[u, w] - d2, 0) / n + lost_pooled[u] / n * middle if n else middle
        p = []
        for c in (0, 1):
            tilted = a(c, w) / middle * shared
            p.append(max(pairs[c][u, w] - d2, 0) / after[c][u] + lost[c][u] / after[c][u] * tilted if after[c][u] else tilted)
        return math.log(p[1]) - math.log(p[0])

    out = []
    for words in asked:
        each = [odds(u, w) for u, w in zip([None, *words], words)]
        out.append([sum(each) / len(each), max(each)] if each else [0.0, 0.0])
    return out


@pytest.mark.parametrize("held", [1 << 20, 0, 25])
def test_odds_are_the_formulas(spark, monkeypatch, held):
    rng = random.Random(9)
    monkeypatch.setattr(toxicity, "PAIR_DISCOUNT", 3)
    monkeypatch.setattr(toxicity, "HELD", held)
    monkeypatch.setattr(toxicity, "FILTER_BITS", 14)
    texts = [(" ".join(rng.choice(["the", "of", "old", f"w{rng.randrange(30)}", "vile scum" if i % 4 == 0 else "kind folk"]) for _ in range(rng.randrange(80))), int(i % 4 == 0)) for i in range(120)]
    labelled = spark.createDataFrame([(i, t, 1, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, fold int, toxic int")
    asked = [texts[0][0], "vile scum of the unseen", "unseen", "", None, "The THE the", "folk scum vile kind"]
    docs = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    got = toxicity._with_features(docs, toxicity.train_odds(labelled), ["doc_id"], "f").orderBy("doc_id").collect()
    want = plain_features([(toxicity.words(t), x) for t, x in texts], [toxicity.words(t) for t in asked], toxicity.DISCOUNT, 3)
    for row, features in zip(got, want):
        assert row["f"] == pytest.approx(features, abs=1e-9), asked[row["doc_id"]]


def test_toxicity_edges_of_rows(spark):
    rows = [(1, "same text", "a"), (1, "same text", "b"), (None, None, "c"), (2, "x " * 200_000, "d"), (3, "same text", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `_fea.tures` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (4, None)], "doc_id long, toxic int")
    scores = [(r["doc_id"], r["score"]) for r in toxicity.toxicity(docs, labels).collect()]
    assert len(scores) == 5 and len({s for i, s in scores if i in (1, 3)}) == 1
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns
    assert toxicity.drop_toxic(docs.where(F.lit(False)), labels).count() == 0
