"""Operators 11 to 13 against brute force on small fixtures, with nulls, ties, repeated rows, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, queries, spelling, whiten

SF = Path("/root/testdata/sf0.001")
RUN = re.compile("[A-Za-zÀ-ÿ]+")


# 11


def counted(rows):
    out = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def edits(a, b):
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def expected_variants(rows):
    n = counted(rows)
    near = {w: [x for x in n if edits(w, x)] for w in n}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def found_variants(docs):
    rows = spelling.variants(docs).collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(scope="module")
def spelled():
    rng = random.Random(11)
    stems = ["kestrel", "Straße", "ÉTUDES", "façades", "running", "runners", "abcdefghij", "zzzzz", "zzzzzz", "x" * 80, "ÿÿÿÿÿ"]
    def noisy(w):
        i, c = rng.randrange(len(w)), rng.choice("aezéß÷")
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
    rows = [(i, rng.choice([" ", "1", "_", "日", "Ā"]).join(noisy(rng.choice(stems)) for _ in range(rng.randrange(60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (None, "kestrel " * 5), (3, rows[3][1]), (3, rows[3][1]), (202, "wanderer " * 3 + "wandered " * 3 + "wandere " * 7)]
    return rows


def test_variants(spark, spelled):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in spelled], "doc_id long, text string, word string, n long").repartition(5)
    expected = expected_variants(spelled)
    assert found_variants(docs) == expected and sum(x[3] > 0 for x in expected.values()) > 50
    assert len({x[1] for x in expected.values()}) < len(expected)
    assert spelling.variants(docs.where("false")).count() == 0 and spelling.variants(docs.where("text is null")).count() == 0


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """Anagrams share all bits, so their bucket holds every word; blocks of a few words find the same pairs."""
    rng = random.Random(5)
    own = {"".join(rng.sample("abcdefg", 7)) for _ in range(500)}
    own |= {w[:i] + rng.choice("abcdefg") + w[i + 1 :] for w in list(own)[:200] for i in (2, 5)}
    rows = [(i, " ".join(list(own) * 3)) for i in (7,)]
    monkeypatch.setattr(spelling, "SMALL", 40)
    monkeypatch.setattr(spelling, "LARGE", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found_variants(docs) == expected_variants(rows)


def test_chains_of_forms_lead_to_one_root(spark):
    rows = [(1, " ".join("abcdefghijklmnop"[: 5 + k] for k in range(9) for _ in range(3 * 2**k)))]
    found = found_variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert found == expected_variants(rows) and found["abcde"][1] == "abcdefghijklm"


def test_long_texts_are_cut_between_runs(monkeypatch):
    text = ("wörter und Worte " * 500 + "x" * 3000 + "é" * 700).encode()
    monkeypatch.setattr(spelling, "PIECE", 100)
    parts = list(spelling.pieces(text))
    assert b"".join(parts) == text and len(parts) > 50
    whole = spelling.tallied([5], [text])
    total = Counter()
    for p in parts:
        total.update(spelling.tallied([5], [p]))
    assert total == whole == {w.encode(): n for w, n in {**counted([(5, text.decode())]), "x" * 3000 + "é" * 700: 1}.items()}


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
def test_variants_of_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = counted(rows)
    places = defaultdict(set)  # words with one letter left out, and where
    for w in n:
        for i in range(len(w)):
            places[w[:i], w[i + 1 :]].add(w)
    found = {r.word: r for r in queries.op11_spelling_variants(spark, str(SF)).collect()}
    assert found.keys() == n.keys()
    for w, r in found.items():
        near = {x for i in range(len(w)) for x in places[w[:i], w[i + 1 :]]} | {w[:i] + w[i + 1 :] for i in range(len(w))} & n.keys()
        near |= {x for i in range(len(w) + 1) for x in places.get((w[:i], w[i:]), ())}
        near.discard(w)
        assert r.n == n[w] and r.n_near == len(near)
        best = min(near, key=lambda x: (-n[x], x), default=None)
        assert r.form == (best if best and n[best] >= 2 * n[w] else None)


# 12


def check_whitened(found, rows, components=16):
    """``found`` against the eigenvectors of the whole covariance."""
    x = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1000000 for i, v in rows}
    fit = np.unique(np.stack(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(axis=0)
    y = (n * fit - s) / n
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(components, int((e > 1e-12 * e[0]).sum()))
    got = defaultdict(dict)
    for r in found:
        got[r.vec_id][r.component] = r
        assert r.n == n and r.identity_error <= 1e-4
        assert r.deviation == sum(int(a) ** 2 for a in n * x[r.vec_id] - s)
        assert r.explained == pytest.approx(e[r.component - 1] / np.trace(cov), rel=1e-9)
    assert got.keys() == x.keys() and all(sorted(c) == list(range(1, k + 1)) for c in got.values())
    ids = list(x)
    for c in range(k):
        if min(abs(e[c] - e[j]) for j in (c - 1, c + 1) if 0 <= j < len(e)) > 1e-6 * e[0]:
            own = np.array([got[i][c + 1].whitened for i in ids])
            true = np.array([(n * x[i] - s) / n @ v[:, c] for i in ids]) / np.sqrt(e[c])
            assert np.abs(own * np.sign(own @ true) - true).max() < 1e-7


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(12)
    scale = np.linspace(3, 0.2, 24)
    return [(i, (rng.standard_normal(24) * scale + 5).astype(np.float32).tolist()) for i in range(150)]


def test_whitening(spark, vectors):
    rows = [*vectors, (3, vectors[3][1]), (900, vectors[4][1])]  # a repeated row and a copy
    bad = [(901, None), (902, []), (903, [*vectors[0][1][:-1], None]), (904, [*vectors[0][1][:-1], float("nan")]), (905, [*vectors[0][1][:-1], float("inf")]), (906, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, "clash", 0.5) for i, v in rows + bad], "vec_id long, embedding array<float>, component string, n double").repartition(4)
    found = whiten.whiten(df).collect()
    assert len(found) == 16 * len(rows)
    check_whitened(found, rows)
    assert whiten.whiten(df, components=3).count() == 3 * len(rows)
    named = whiten.whiten(df, keep=("vec_id", "n")).columns
    assert named == ["vec_id", *whiten.NEW]


def test_whitening_of_little(spark, vectors):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], vectors[:1], [(i, [1.0, 2.0]) for i in range(4)]):
        out = whiten.whiten(spark.createDataFrame(rows, kind))
        assert out.columns == ["vec_id", *whiten.NEW] and out.count() == 0
    line = [(i, [float(i), 2.0 * i, 3.0]) for i in range(5)]  # rank 1
    check_whitened(whiten.whiten(spark.createDataFrame(line, kind)).collect(), line)
    large = [(i, [3e9 * i, 1.0]) for i in range(3)]  # deviations beyond 64 bits are null
    found = whiten.whiten(spark.createDataFrame(large, kind)).collect()
    assert {r.vec_id for r in found} == {0, 1, 2} and all((r.deviation is None) == (r.vec_id != 1) for r in found)


@pytest.mark.parametrize("spectrum", ["flat", "steep", "multiple", "short"])
def test_lanczos(spectrum):
    """Restarts, breakdowns and multiple eigenvalues, against the eigenvalues of the whole matrix."""
    rng, d = np.random.default_rng(3), 120
    values = {"flat": np.linspace(2, 1, d), "steep": 0.7 ** np.arange(d), "multiple": np.repeat([5.0, 3.0, 1.0], d // 3), "short": np.append([4.0, 3.0, 2.0], np.zeros(d - 3))}[spectrum]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    m = q * values @ q.T
    found, vectors, residuals = whiten.lanczos(lambda b: m @ b, d, 6, block=4, limit=48, tolerance=1e-13, passes=2000)
    assert np.abs(found - np.sort(values)[::-1][:6]).max() < 1e-11
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-11 and residuals.max() < 1e-11


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
def test_whitening_of_the_embeddings(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitened(queries.op12_block_lanczos(spark, str(SF)).collect(), rows)


# 13


def plain(rows):
    """Turns of each conversation by the definition."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [t[1:] for t in sorted(own)] for c, own in out.items()}


def template(turns):
    """The text of a conversation, and the spans of the assistant's texts in its bytes."""
    text, spans = "", []
    esc = lambda t, role=False: re.sub(r"#(?=##)|<(?=/(?:turn|part)>)" + (r"|:(?=\n)" if role else ""), lambda m: m[0] + "\\", t.replace("\\", "\\\\"))
    for i, (role, said) in enumerate(turns):
        text += "</part>" if i and turns[i - 1][0] == role else f"### {esc(role, True)}:\n"
        if role == "assistant":
            spans.append((len(text.encode()), len(esc(said).encode())))
        text += esc(said) + ("" if turns[i + 1 : i + 2] and turns[i + 1][0] == role else "</turn>\n")
    return text, spans


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(13)
    marks = ["###", "####", "#", "\\", "\\#", "</turn>", "</part>", "<\\/turn>", "\n", ":\n", "### user:\n", "é日𝄞", "ok", " ", "</turn>\n", ""]
    make = lambda n: "".join(rng.choice(marks) for _ in range(rng.randrange(n)))
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", make(4), None]), rng.choice([make(12), make(12), None])) for c in range(80) for t in range(rng.randrange(1, 9))]
    return [*rows, *rows[:5], (None, 1, "user", "of null"), (None, None, "assistant", "first"), (500, 1, "assistant", "a"), (500, 1, "assistant", "a"), (501, 1, "user", "u"), (501, 1, "assistant", "tie")]


def test_chats_are_formatted_and_read_back(spark, talk):
    df = spark.createDataFrame([(*r, "clash") for r in talk], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    found = chat.read(chat.formatted(df)).collect()
    expected = plain(talk)
    assert len(found) == len(expected)
    for r in found:
        turns = expected[r.conv_id]
        text, spans = template(turns)
        assert r.formatted == text and [tuple(s) for s in r.loss] == spans
        assert [tuple(t) for t in r.turns] == turns and r.n_turns == len(turns)
        assert r.learned == [t for role, t in turns if role == "assistant"]
    assert chat.formatted(df.where("false")).count() == 0
    assert [len(r.loss) for r in chat.formatted(df, learned=("user", "system")).where("conv_id = 501").collect()] == [1]


def test_a_long_conversation_costs_no_square(spark):
    """100,000 turns of one conversation: the work of a fold that copies its sums would be 10 ** 10."""
    n = 100_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("ä "), "id").alias("text"))
    r = chat.read(chat.formatted(df)).select("n_turns", F.size("turns").alias("read"), F.sha2(chat.glued(F.col("learned")), 256).alias("digest")).first()
    learned = "".join(f"ä {i}" for i in range(n) if i % 3)
    assert (r.n_turns, r.read) == (n, n) and r.digest == hashlib.sha256(learned.encode()).hexdigest()


@pytest.mark.skipif(not SF.is_dir(), reason="no test tables")
def test_chats_by_sql_and_without_python(spark):
    duckdb = pytest.importorskip("duckdb")
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    found = queries.op13_relational_chat(spark, str(SF))
    expected = duckdb.sql(queries.oracle_sql()["op13_relational_chat"])
    assert sorted(found.columns) == sorted(expected.columns)
    assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(expected.fetchall())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    own = found.where("conv_id = -7").first()
    assert own.n_turns == 2 and own.loss_chars == len(r"\### Assistant: </turn> ok")
