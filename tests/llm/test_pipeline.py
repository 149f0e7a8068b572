"""The pipeline, stage by stage, each against brute force on what its predecessor kept."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from test_corpus_operators import SCHEMA, cut_lines, rows, words  # noqa: F401

import corpus_pipeline


@pytest.fixture(scope="module")
def stages(spark, rows, tmp_path_factory):  # noqa: F811
    folder = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame(rows, SCHEMA).select(*corpus_pipeline.COLUMNS)
    docs.write.parquet(f"{folder}/documents.parquet")
    out, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append((before, [tuple(r) for r in docs.collect()]))
    return folder, out


def test_language_keeps_what_it_knows(stages):
    before, after = stages[1][0]
    gone = {r[0] for r in before} - {r[0] for r in after}
    assert gone >= {100, 101, 102, 103} and not gone & set(range(60))


def test_language_keeps_languages_of_many_rare_ngrams(spark):
    """Scores fall where rare n-grams outgrow a language's slice; its documents stay, foreign ones go."""
    rng = random.Random(1)
    letters, han = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîï", [chr(x) for x in range(0x4E00, 0x4E00 + 4000)]
    common_ = ["".join(rng.choices(letters, k=5)) for _ in range(30)]
    made = lambda: " ".join(rng.choice(common_) if rng.random() < 0.3 else "".join(rng.choices(letters, k=6)) for _ in range(150))
    docs = [(i, made(), "xx") for i in range(200)] + [(i, "".join(rng.choices(han, k=400)), "zh") for i in range(200, 400)] + [(400, "αβγδε ζηθικ λμνξο πρστυ", None), (401, "한국어 문서", None)]
    rows = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language(spark, rows, "").collect()} == set(range(400))


def test_language_is_not_taught_by_the_document_it_judges(spark):
    """Of labelled and unlabelled gibberish among clean documents at least 90 % goes, and 98 % of what is clean stays."""
    rng = random.Random(7)
    en, de = "the of and to in is that with for as was on are by this be at from it which house water".split(), "der die das und ist nicht ein eine mit für auf dem den von zu über haus wasser strasse".split()
    clean = lambda own: " ".join(rng.choice(own) + rng.choice(["", "", "er", "ing", "en"]) for _ in range(rng.randint(20, 200)))
    noise = lambda: " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(60))
    docs = [(i, clean(en if i % 2 else de), "en" if i % 2 else "de") for i in range(300)]
    docs += [(1000 + i, noise(), "en" if i < 20 else None) for i in range(40)]
    rows = spark.createDataFrame([(i, t, lang, "s", len(t)) for i, t, lang in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.language(spark, rows, "").collect()}
    assert len([i for i in kept if i < 1000]) >= 0.98 * 300
    assert len([i for i in kept if 1000 <= i < 1020]) <= 2 and len([i for i in kept if i >= 1020]) <= 2


def test_lines(stages):
    before, after = stages[1][1]
    expected = cut_lines(before)
    by_id = defaultdict(list)
    for (i, _), text in expected.items():
        by_id[i].append(text)
    assert len(before) == len(after) and all(r[1] in by_id[r[0]] for r in after)


def test_near(stages):
    before, after = stages[1][2]
    sets = {(i, t): frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := words(t)) else None for i, t, *_ in before}
    groups = [{k} for k, s in sets.items() if s]
    for a in range(len(groups)):
        for b in range(a):
            if groups[a] and groups[b] and any(len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) for x in groups[a] for y in groups[b]):
                groups[a] |= groups[b]
                groups[b] = set()
    def order(k):
        return (k[0] is not None, k[0] or 0, hashlib.md5((("\1" if k[0] is None else str(k[0])) + "\0" + (k[1] or "")).encode()).digest())
    expected = Counter(min(g, key=order) for g in groups if g) + Counter((i, t) for i, t, *_ in before if not sets[i, t])
    assert Counter((r[0], r[1]) for r in after) == expected


def test_substrings(stages):
    before, after = stages[1][3]
    n = Counter(tuple(w[i : i + 35]) for _, t, *_ in before for w in (words(t),) for i in range(len(w) - 34))
    expected = defaultdict(list)
    for i, t, *_ in before:
        w = words(t)
        gone = {j for k in range(len(w) - 34) if n[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        expected[i].append(" ".join(x for j, x in enumerate(w) if j not in gone) if gone else t)
    assert len(before) == len(after) and all(r[1] in expected[r[0]] for r in after)


def test_pack_and_run(spark, stages):
    folder, out = stages
    before, after = out[4]
    assert {r[0] for r in before} == {r[0] for r in after}
    whole = corpus_pipeline.run(spark, str(folder)).collect()
    assert sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in whole) == sorted((str(r[0]), r[1], r[2], r[3]) for r in after)


def test_stages_of_empty_tables_and_extra_columns(spark, tmp_path):
    """Every stage of an empty table is empty; columns that ``documents`` doesn't have, clashing ones among them, are left out."""
    names = (*corpus_pipeline.COLUMNS, "n_words", "score", "class_id", "n_removed", "sequence_id", "root", "node")
    kinds = ", ".join(f"{c} {'long' if c in ('doc_id', 'n_chars') else 'string'}" for c in names)
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"{text} and {i} of these are here", "en", "s", 1, *["clash"] * 7) for i in range(8)] + [(None, None, None, None, None, *[None] * 7), (8, "", "en", None, None, *["x"] * 7)]
    for name, own in (("none", []), ("some", rows)):
        docs = spark.createDataFrame(own, kinds)
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            last = i == len(corpus_pipeline.STAGES) - 1
            assert last or tuple(out.columns) == corpus_pipeline.COLUMNS
            out.write.parquet(f"{tmp_path}/{name}{i}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
        assert docs.isEmpty() == (not own)
