"""The corpus operators against libraries, brute force, round trips and planted cases."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulith.llm import bitsearch, bpe, exactdedup, htmltext, linededup, minhash, mixing, pii, shingles, tokencount, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "a" * 5000, "Hello  World's <|endoftext|> 42!", "日本語 émoji \U0001f600 ", "same", "same", "x\x00y\x1cz"]


def docs_of(spark, texts, extra: bool = True):
    """Documents with columns whose names clash with what operators use inside."""
    rows = [(i, t, "en", f"k{i}", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, norm string, n long")
    return df.withColumnRenamed("norm", "_key") if extra else df.select("doc_id", "text")


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def clean(text):
    return re.sub("[\x20\x09-\x0d]", "", text or "")


# 1: exact top-k search

def brute_topk(codes, queries, k):
    out = {}
    for q, code in set(queries):
        near = sorted((bin((code ^ c) & (2**64 - 1)).count("1"), i) for i, c in set(codes) if i != q)
        out[q] = near[:k]
    return out


@pytest.mark.parametrize("segments", [None, 4, 8])
def test_search_is_brute_force(spark, segments):
    random.seed(segments or 1)
    base = [random.getrandbits(63) for _ in range(6)]
    codes = [(i, random.choice(base) ^ (1 << random.randrange(63)) ^ (1 << random.randrange(63))) for i in range(60)]
    codes += [(100 + i, base[0]) for i in range(30)]  # a third of all rows is one code
    codes += codes[:3]  # repeated rows
    df = spark.createDataFrame(codes, "id long, code long")
    asked = [c for c in codes if c[0] % 10 == 0]
    got = bitsearch.search(df, spark.createDataFrame(asked, "id long, code long"), 5, segments).collect()
    found = {q: [(r["distance"], r["id"]) for r in sorted(rows, key=lambda r: r["rank"])] for q, rows in itertools.groupby(sorted(got, key=lambda r: r["query_id"]), lambda r: r["query_id"])}
    assert found == brute_topk(codes, asked, 5)


def test_search_edges(spark):
    none = spark.createDataFrame([], "id long, code long")
    one = spark.createDataFrame([(1, 5)], "id long, code long")
    assert bitsearch.search(none, none).count() == 0
    assert bitsearch.search(one, one).count() == 0
    vectors = spark.createDataFrame([(1, [1.0, -1.0, None, float("nan")]), (2, None), (None, [1.0])], "vec_id long, embedding array<double>")
    assert [(r["id"], r["code"]) for r in bitsearch.sign_codes(vectors).collect()] == [(1, 1)]


# 2: line deduplication

def brute_lines(texts, least):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\v\f\r").translate(fold)
    count = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            count[k] = count.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if count.get(key(x), 0) < least]
        out.append((len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return out


TEXTS = [None, "", "\n\n", "Same Line\nother", " same line\t\nÉ", "same LINE", "x\n x \nX", "É\né", "only\x0bone", "a" * 3000 + "\nsame line"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_lines_are_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(linededup, "BROADCAST_BYTES", -1)
    got = {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in linededup.line_dedup(docs_of(spark, TEXTS), 3).collect()}
    assert [got[i] for i in range(len(TEXTS))] == brute_lines(TEXTS, 3)


def test_lines_are_reversible(spark):
    a, b = docs_of(spark, TEXTS[:6], False), docs_of(spark, TEXTS[3:], False).withColumn("doc_id", F.col("doc_id") + 100)
    start = linededup.change(linededup.empty_state(spark), a, 1, 3)
    back = linededup.change(linededup.change(start, b, 1, 3), b, -1, 3)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(back[0]) == rows(start[0])
    one = linededup.drop_frequent_lines(a, start, 3)
    assert rows(linededup.drop_frequent_lines(a, back, 3)) == rows(one)
    assert linededup.line_dedup(a.limit(0)).count() == 0


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    found = linededup.CuckooFilter(3000)
    assert found.insert(keys) and found.contains(keys).all()
    assert found.contains(rng.integers(0, 2**64, 20000, dtype=np.uint64)).mean() < 0.001
    found.delete(keys[:1500])
    assert linededup.CuckooFilter.from_bytes(found.to_bytes()).contains(keys[1500:]).all()
    assert found.contains(keys[:1500]).mean() < 0.01


# 3 and 6: tokenizers

def odd_texts():
    random.seed(2)
    letters = list(" abS'T\n\t.0<|>日İΣς́\U0001f600éÉßre_-=  xyz▁\x00\x1c\x85 ٣") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "<s>", "<0x0A>"]
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(60))) for _ in range(3000)]
    return texts + [t or "" for t in ODD] + [" " * 300, "!?" * 500, "aaaa aaa aa", "=-" * 400]


def test_bpe_is_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = public_tokenizers.path("word_bpe_49k.json")
    library, texts = tokenizers.Tokenizer.from_file(path), odd_texts()
    got = list(bpe.WordBpe(path).encode_batch(texts))
    for text, (n, ids, decoded) in zip(texts, got):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False)), repr(text)
    rows = {r["doc_id"]: r for r in bpe.encode_documents(docs_of(spark, ODD), path).collect()}
    assert rows[0]["n_tokens"] == 0 and rows[0]["ids"] == [] and rows[0]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert rows[6]["ids"] == library.encode("same", add_special_tokens=False).ids


def test_counts_are_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = public_tokenizers.path("piece_bpe_32k.model")
    library, texts = sentencepiece.SentencePieceProcessor(model_file=path), odd_texts()
    counter = tokencount.Counter(path)
    assert [counter(t) for t in texts] == [len(library.encode(t)) for t in texts]
    rows = {r["doc_id"]: r for r in tokencount.token_counts(docs_of(spark, ODD), path, 3).collect()}
    assert (rows[0]["n_bytes"], rows[0]["n_tokens"], rows[0]["over_limit"]) == (0, 0, False)
    assert rows[5]["n_bytes"] == len(ODD[5].encode()) and rows[5]["over_limit"]


# 4: near-duplicates

def brute_classes(texts):
    flat, starts = shingles.cells(texts)
    sets = [flat[starts[i] : starts[i + 1]] for i in range(len(texts))]
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if shingles.similarity(sets[i], sets[j]) >= 0.8:
            a, b = sorted((top(i), top(j)))
            parent[b] = a
    return [top(i) for i in range(len(texts))]


def near_texts():
    random.seed(4)
    word = lambda: "".join(random.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(5):
        base = [word() for _ in range(120)]
        for edits in (0, 0, 1, 2, 3, 5, 9):
            copy = list(base)
            for at in random.sample(range(len(copy)), edits):
                copy[at] = word()
            texts.append(" ".join(copy))
    return [*texts, *ODD, "one two", "One, two!", "one two three"]


def test_near_duplicates_are_brute_force(spark):
    texts = near_texts()
    got = {r["doc_id"]: r["class_id"] for r in minhash.near_duplicates(docs_of(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_classes(texts)


def test_dart_signatures_estimate_similarity():
    random.seed(6)
    base = [str(random.randrange(10**6)) for _ in range(500)]
    other = base[:450] + [str(random.randrange(10**6)) for _ in range(50)]
    flat, starts = shingles.cells([" ".join(base), " ".join(other), "", "one"])
    signature = minhash.dart_signatures(flat, starts, 3000)
    true = shingles.similarity(flat[starts[0] : starts[1]], flat[starts[1] : starts[2]])
    assert abs((signature[0] == signature[1]).mean() - true) < 0.04
    assert not signature[2].any() and signature[3].all()


def test_near_duplicate_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b, c d e F")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["class_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert minhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    kept = minhash.keep_one_of_each_class(docs_of(spark, ["a b c d e f"] * 3 + [None, ""]))
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 3, 4] and "_key" in kept.columns


def test_components(spark):
    chain = [(i, i + 1) for i in range(20)] + [(50, 52), (51, 52)]
    got = {r["id"]: r["class_id"] for r in minhash.components(spark.createDataFrame(chain, "low long, high long")).collect()}
    assert got == {**{i: 0 for i in range(1, 21)}, 51: 50, 52: 50}


# 5: mixing

def test_mixing_meets_targets(spark):
    targets = {"good": 0.8, "low": 0.15, "toxic": 0.05}
    rows = mixing.mix(documents(spark), labels(spark), targets).toPandas()
    totals = {d: (rows["tokens"] * rows["rate"] * rows[f"p_{d}"]).sum() for d in targets}
    assert (rows["rate"] >= 0).all() and len(rows) == documents(spark).count()
    for d, share in targets.items():
        assert totals[d] / sum(totals.values()) == pytest.approx(share, abs=0.01)
    assert np.allclose(rows[["p_good", "p_low", "p_toxic"]].sum(axis=1), 1)
    assert (abs(rows["copies"] - rows["rate"]) < 1).all()


def test_mixing_edges(spark):
    none = labels(spark).limit(0)
    rows = mixing.mix(docs_of(spark, ODD), none).collect()
    assert len(rows) == len(ODD) and all(r["rate"] >= 0 for r in rows)
    assert mixing.mix(docs_of(spark, ODD).limit(0), labels(spark)).count() == 0
    out = mixing.apply_mix(documents(spark).withColumn("tokens", F.lit("mine")), labels(spark))
    assert out.columns == [*documents(spark).columns, "tokens"]


# 7: exact deduplication

def test_exact_dedup_is_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SMALL}/documents.parquet')")
    want = sorted(map(tuple, con.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exactdedup.ORACLE_SQL})").fetchall()))
    got = exactdedup.exact_dedup(documents(spark)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want


def test_exact_dedup_edges(spark):
    texts = ["a b", "ab", "a  b", None, "", " \t\n", "ab\x0b", "é", "e"]
    got = {r["doc_id"]: r for r in exactdedup.exact_dedup(docs_of(spark, texts)).collect()}
    assert {i for i, r in got.items() if r["kept"]} == {2, 5, 7, 8}
    assert got[0]["keep_id"] == 2 and got[0]["group_size"] == 4 and got[3]["keep_id"] == 5
    assert got[0]["text_sha256"] == hashlib.sha256(clean("a b").encode()).hexdigest()
    repeated = spark.createDataFrame([(1, "x"), (1, "x"), (None, "x"), (2, "X")], "doc_id long, text string")
    rows = exactdedup.exact_dedup(repeated).collect()
    assert len(rows) == 4 and sum(r["kept"] for r in rows) == 2
    assert sorted(r["doc_id"] or 0 for r in exactdedup.keep_first_copies(repeated).collect()) == [0, 2]
    assert exactdedup.exact_dedup(repeated.limit(0)).count() == 0


def test_exact_dedup_hot_group(spark):
    texts = ["hot text"] * 400 + [f"text {i // 2}" for i in range(800)]
    got = exactdedup.exact_dedup(docs_of(spark, texts)).collect()
    assert len(got) == 1200 and sum(r["kept"] for r in got) == 401
    assert {r["group_size"] for r in got} == {400, 2}


# 8: pseudonyms

def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


PRIVATE = [
    ("mail", "und.34@mail7.example.com", r"[a-z]{3}\.[0-9]{2}@mail7\.example\.com"), ("phone", "+1 (017) 555-7713", r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}"),
    ("card", "4111111111111111", r"[0-9]{16}"), ("card2", "4111-1111-1111-1111", r"[0-9]{4}(-[0-9]{4}){3}"), ("ip", "97.51.17.173", r"[0-9]{1,3}(\.[0-9]{1,3}){3}"),
    ("date", "1999-12-31", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("ssn", "078-05-1120", r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), ("iban", "DE89 3704 0044 0532 0130 00", r"DE[0-9]{2}( [0-9]{4}){4} [0-9]{2}"),
    ("secret", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', r'token = "[0-9a-f]{40}"'),
]
NOT_PRIVATE = ["4111111111111112", "300.1.2.3", "2000-02-30", "000-05-1120", "DE00 3704 0044 0532 0130 00", "version 4.0", "1234567", "10.5%", "a1b2c3"]


def test_pseudonyms_keep_formats(spark):
    texts = [f"before {p} after" for _, p, _ in PRIVATE] + [f"x, {p}." for _, p, _ in PRIVATE] + [f"before {p} after" for p in NOT_PRIVATE]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs_of(spark, texts), "key").collect()}
    n = len(PRIVATE)
    for i, (kind, value, pattern) in enumerate(PRIVATE):
        first = re.fullmatch(f"before ({pattern}) after", got[i]["text"])
        again = re.fullmatch(rf"x, ({pattern})\.", got[n + i]["text"])
        assert first and again and first[1] == again[1] != value and got[i]["n_found"] == 1, kind
        if kind.startswith("card"):
            assert luhn(first[1].replace("-", ""))
        if kind == "iban":
            plain = first[1].replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    for i, value in enumerate(NOT_PRIVATE):
        assert got[2 * n + i]["text"] == f"before {value} after" and got[2 * n + i]["n_found"] == 0, value


def test_pseudonyms_are_permutations(spark):
    days = [f"{2000 + i // 300:04d}-{1 + i % 12:02d}-{1 + i % 28:02d}" for i in range(600)]
    ips = [f"10.{i % 7}.{i // 7}.{i % 250}" for i in range(600)]
    for values in (sorted(set(days)), sorted(set(ips))):
        got = [r["text"] for r in pii.pseudonymise(docs_of(spark, values), "key").collect()]
        assert len(set(got)) == len(values)
    texts = docs_of(spark, ODD)
    assert [r["text"] for r in pii.pseudonymise(texts, "k").orderBy("doc_id").collect()] == ODD
    other = pii.pseudonymise(docs_of(spark, ["10.1.2.3"]), "another").first()["text"]
    assert other != pii.pseudonymise(docs_of(spark, ["10.1.2.3"]), "key").first()["text"]


def test_pseudonyms_beside_words_and_in_timestamps(spark):
    values = [
        ("ES91 2100 0418 4502 0005 1332", " BIC", r"ES[0-9]{2}( [0-9]{4}){5}"), ("BE68 5390 0754 7034", " EUR", r"BE[0-9]{2}( [0-9]{4}){3}"),
        ("BE68539007547034", " EUR 1000", r"BE[0-9]{14}"), ("DE89 3704 0044 0532 0130 00", " BIC", r"DE[0-9]{2}( [0-9]{4}){4} [0-9]{2}"),
        ("2021-03-04", "T10:15:00Z", r"[0-9]{4}-[0-9]{2}-[0-9]{2}"), ("+14155550123", ".", r"\+1[0-9]{10}"), ("+44 7911 123456", " or", r"\+44 [0-9]{4} [0-9]{6}"),
        ("+44 20794 60958", ",", r"\+44 [0-9]{5} [0-9]{5}"), ("+49 30 12345678", ",", r"\+49 [0-9]{2} [0-9]{8}"),
    ]
    texts = [f"see {v}{after}" for v, after, _ in values] + [f"see {v}, then" for v, _, _ in values]
    got = {r["doc_id"]: r for r in pii.pseudonymise(docs_of(spark, texts), "key").collect()}
    for i, (value, after, pattern) in enumerate(values):
        made = re.fullmatch(f"see ({pattern}){re.escape(after)}", got[i]["text"])
        alone = re.fullmatch(f"see ({pattern}), then", got[len(values) + i]["text"])
        assert made and alone and made[1] == alone[1] != value and got[i]["n_found"] == 1, (value, got[i])
    left = ["x+14155550123", "+1.41421356", "2021-03-04Tx", "+1234567"]
    assert [r["text"] for r in pii.pseudonymise(docs_of(spark, left), "key").orderBy("doc_id").collect()] == left


# 9: toxicity

def test_toxicity_on_held_out_rows(spark):
    big = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    rows = toxicity.toxicity(docs, marks)
    assert rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0 and rows.count() == docs.count()
    held = rows.join(marks, "doc_id").where("held_out")
    right, n = held.agg(F.count_if(F.col("predicted") == F.col("toxic")), F.count(F.lit(1))).first()
    base = held.agg(F.avg((F.col("toxic") == 0).cast("int"))).first()[0]
    assert right / n > base + 0.03, (right, n, base)


def test_toxicity_edges(spark):
    rows = toxicity.toxicity(docs_of(spark, ODD), labels(spark).limit(0)).collect()
    assert len(rows) == len(ODD) and len({r["score"] for r in rows}) == 1 and not any(r["predicted"] for r in rows)
    assert toxicity.toxicity(docs_of(spark, ODD).limit(0), labels(spark)).count() == 0
    kept = toxicity.drop_toxic(docs_of(spark, ODD), labels(spark).limit(0))
    assert kept.count() == len(ODD) and kept.columns == docs_of(spark, ODD).columns
    import zlib

    folds = docs_of(spark, ODD).select("doc_id", toxicity.fold(F.col("doc_id")).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in folds)


def _labelled_words(spark):
    """300 documents of words that stand in toxic or in ordinary ones only, and their labels."""
    rng = random.Random(9)
    rows = []
    for i in range(300):
        toxic = int(i % 3 == 0)
        rows.append((i, " ".join(rng.choice([f"plain{rng.randrange(40)}", f"{'bad' if toxic else 'good'}{rng.randrange(40)}"]) for _ in range(60)), toxic))
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return rows.select("doc_id", "text"), rows.select("doc_id", "toxic")


def test_toxicity_of_an_unseen_word_is_no_strangers(spark):
    docs, marks = _labelled_words(spark)
    # a word that shares the low 20 bits of its hash with one toxic word, and bits 21 to 40 with another
    hashes = toxicity._Hashes()
    low = {hashes[f"bad{k}"] & 0xFFFFF for k in range(40)}
    word = next(w for w in (f"w{i}" for i in itertools.count()) if hashes[w] & 0xFFFFF in low)
    second = next(w for w in (f"v{i}" for i in itertools.count()) if hashes[w] >> 21 & 0xFFFFF == hashes[word] >> 21 & 0xFFFFF and w != word)
    more = spark.createDataFrame([(1000 + i, " ".join(f"bad{k} {second}" for k in range(40))) for i in range(20)], "doc_id long, text string")
    docs, marks = docs.union(more), marks.union(more.selectExpr("doc_id", "1"))
    asked = spark.createDataFrame([(-1, word), (-2, "neverseen")], "doc_id long, text string")
    scores = [r["score"] for r in toxicity.toxicity(docs.union(asked), marks).where("doc_id < 0").collect()]
    assert len(scores) == 2 and scores[0] == scores[1]


@pytest.mark.parametrize("held", [0, 30])
def test_toxicity_beyond_what_is_held(spark, monkeypatch, held):
    docs, marks = _labelled_words(spark)
    docs = docs.union(spark.createDataFrame([(None, None), (None, "bad1 plain2"), (7, "bad3 bad3 good1")], docs.schema))
    want = sorted((r["doc_id"] or -1, round(r["score"], 12)) for r in toxicity.toxicity(docs, marks).collect())
    monkeypatch.setattr(toxicity, "HELD", held)
    got = sorted((r["doc_id"] or -1, round(r["score"], 12)) for r in toxicity.toxicity(docs, marks).collect())
    assert got == want and len({s for _, s in want}) > 10


# 10: main text of pages

PAGE = (
    "<html><head><title>t</title><style>p{{}}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href=/>menu</a></li></ul></nav><!-- ad --><div class='ad'>advert words here</div>{}"
    "<aside>side</aside><div id=comments><p>a comment of a reader</p></div><footer>&copy; foot</footer></body></html>"
)


@pytest.mark.parametrize(
    "body, want",
    [
        ("<article><h1>Head &amp; more</h1><p>One\n  two<p>Short<br>line</article>", "Head & more\nOne two\nShort line"),
        ("<main><p>x</p><form><p>name</p></form><p>y&nbsp;z</main>", "x\ny z"),
        ("<article><header><h1>T</h1><p>by me</p></header><p>a <b>bold</b>er <a href=x>link</a></p></article>", "T\na bolder link"),
        ("<div><p>" + "word " * 30 + "</p><p>ok</p><p>" + "tail " * 30 + "</p></div>", "word " * 29 + "word\nok\n" + "tail " * 29 + "tail"),
        ("", ""),
    ],
)
def test_main_text(body, want):
    assert htmltext.main_text(PAGE.format(body)) == want


def test_pages(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = {r["page_id"]: r for r in htmltext.extract_pages(pages).collect()}
    for row in pages.collect():
        from html import unescape

        article = re.search("<article>(.*?)(</article>|$)", row["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub("<[^>]+>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        want = "\n".join(b for b in blocks if b)
        assert got[row["page_id"]]["text"] == want and got[row["page_id"]]["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, "u", None, 1), (2, "u", "", 2), (3, None, "<p", 3), (None, "u", "<p>x", 4)], "page_id long, url string, html string, text int")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in htmltext.extract_pages(odd).collect())[:3] == [(0, "x", 1), (1, "", 0), (2, "", 0)]


# the pipeline

@pytest.mark.parametrize("share", [1, 1000])
def test_first_copies_of_null_and_repeated_ids(spark, monkeypatch, share):
    from tabulith.llm import common

    monkeypatch.setattr(common, "HOT_SHARE", share)
    rows = [(None, "x", 1), (None, "y", 2), (None, "y", 3), (5, "long unique text", 4), (5, "u", 5), (5, "long unique text", 6), (4, "b  c", 7), (5, "bc", 8), (6, None, 9), (6, "z", 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other int")
    got = exactdedup.keep_first_copies(docs)
    assert got.columns == docs.columns
    found = sorted((r["doc_id"] or 0, r["text"] or "") for r in got.collect())
    assert found == [(0, "x"), (0, "y"), (4, "b  c"), (5, "long unique text"), (5, "u"), (6, ""), (6, "z")]
    assert len(found) == exactdedup.exact_dedup(docs).where("kept").count()


def test_toxic_rows_of_null_and_repeated_ids(spark):
    docs, marks = _labelled_words(spark)
    bad, good = " ".join(["bad1 bad2 bad3"] * 9), " ".join(["good1 good2 good3"] * 9)
    more = [(None, bad), (None, good), (9001, bad), (9001, good), (9002, good)]
    every = docs.union(spark.createDataFrame(more, docs.schema)).withColumn("features", F.lit("own"))
    left = toxicity.drop_toxic(every, marks)
    assert left.columns == every.columns
    kept = left.where("doc_id IS NULL OR doc_id > 9000").collect()
    assert sorted((r["doc_id"] or 0, r["text"], r["features"]) for r in kept) == [(0, good, "own"), (9001, good, "own"), (9002, good, "own")]


def test_near_copies_of_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (5, one + " end"), (5, two), (7, three), (7, three + " end"), (None, one), (None, two)]
    got = minhash.keep_one_of_each_class(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {(1, one), (5, two), (None, one), (None, two)} <= set(map(tuple, got))
    assert sum(r["doc_id"] == 7 for r in got) == 1


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["toxicity", "exact dedup", "near dedup", "mixing", "bpe"]
    docs = documents(spark)
    counts = [docs.count()]
    for k, (_, stage) in enumerate(p.STAGES):
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(docs.count())
        if k < len(p.STAGES) - 1:
            assert docs.columns == documents(spark).columns
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5]
    assert sorted(r["doc_id"] for r in p.run(spark, SMALL).select("doc_id").collect()) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
