"""Each operator against brute force on a small fixture with nulls, empties, copies, repeated rows and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, exchange, kneser_ney, langid, linechunks, lshforest, mih, packing, ppm, rules, segment, substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score string"


def words(x):
    return WORD.findall(x or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    vocabulary = {"en": "the of and to in is that with for as was on are by this be at from it".split(), "de": "der die das und ist nicht ein eine mit für auf dem den von zu über".split()}
    def sentence(lang, n):
        return " ".join(rng.choice(vocabulary[lang]) + rng.choice(["", "", "er", "ing", "ung"]) for _ in range(n)).capitalize() + "."
    out = []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        out.append([i, "\n".join(sentence(lang, rng.randint(4, 30)) for _ in range(rng.randint(1, 9))), lang, f"src{i % 3}"])
    shared = "\n".join(sentence("en", 20) for _ in range(6))
    out[3][1] = f"{out[3][1]}\n{shared}\n{out[5][1]}"
    out[8][1] = f"{shared}\nand more of it"
    out[10][1] = out[4][1]
    out[12][1] = out[4][1].replace(out[4][1].split()[0], "Other", 1)
    out += [[100, None, "en", "src0"], [101, "", None, None], [102, "  \n\t ", "en", None], [103, "123 456 !!", "de", "src1"], [104, "wort " * 20_000, "de", "src1"], [105, "x" * 50_000, None, "src1"], [106, "日本語   ▁ tab\there  two", "en", "src0"], [None, "a null id of the and", "en", "src0"], [107, "é à the ones", "en", "src0"], [4, out[4][1], "en", "src2"]]
    return [(i, t, lang, source, len(t or ""), "clash", "clash") for i, t, lang, source in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(docs, empty):
    learn = ~common.is_remainder("doc_id", 4, 2)
    found = {r.doc_id: r for r in langid.identify(docs, learn=learn, keep=("doc_id", "lang", "score")).collect()}
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (100, 101, 102, 103))
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and sum(found[i].lang_pred == found[i].lang for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in found.values())
    # by sets in place of filters: the same answers, and the same scores but for what false positives vary
    count = {"de": Counter(), "en": Counter()}
    for r in docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).collect():
        count[r.lang].update(grams(r.text))
    share = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in count.items()}
    members = {x: {g for g, s in own.items() if s >= langid.LEAST * max(o.get(g, 0) for o in share.values())} for x, own in share.items()}
    for r in docs.collect():
        own = grams(r.text or "")
        if own:
            exact = {x: sum(g in m for g in own) / len(own) for x, m in members.items()}
            got = found[r.doc_id]
            assert got.n_grams == len(own) and got.score == pytest.approx(max(exact.values()), abs=0.02 + 0.2 / len(own))
            if abs(exact["de"] - exact["en"]) > 0.05:
                assert got.lang_pred == max(sorted(exact), key=exact.get)
    assert langid.identify(docs, learn=F.lit(False)).where("lang_pred <> 'und'").isEmpty()
    assert langid.identify(empty).count() == 0


def grams(text):
    """Letter n-grams of 3 and 4 with their borders, of 1 and 2 in scripts of many letters, by the definition."""
    many = lambda c: any(a <= ord(c) <= b for a, b in langid.MANY)
    out = []
    for script, orders, border in ((False, (3, 4), " "), (True, (1, 2), "")):
        runs = "".join(c if c.isalpha() and many(c) == script else "\n" for c in text.lower()).split("\n")
        for run in filter(None, runs):
            run = border + run + border
            out += [run[i : i + n] for n in orders for i in range(len(run) - n + 1)]
    return out


def test_filter_holds_all_members():
    """An n-gram's bitmask has the bit of every language that has it, and few others."""
    rng = np.random.default_rng(8)
    members = {x: rng.integers(0, 1 << 63, 3000).astype(np.uint64) for x in ("a", "b", "c")}
    members["b"][:500] = members["a"][:500]
    model = langid.BitSliced.of(members)
    for i, x in enumerate(model.languages):
        held = model.languages_of(members[x])[:, 0] >> np.uint64(i) & np.uint64(1)
        assert held.all()
        other = model.languages_of(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))[:, 0] >> np.uint64(i) & np.uint64(1)
        assert other.mean() == pytest.approx(model.false_share[i], abs=0.005) and model.false_share[i] < 0.02


def test_long_texts_are_cut_between_words():
    text = "abc déf, ghij " * 30 + "x" * 80 + " end"
    held = [x for _, some in langid.spans([text, "", "q"], 50) for x in some]
    assert "".join(held[:-2]) == text and held[-2:] == ["", "q"] and len(held) > 8
    whole = Counter(langid.gram_keys([text])[0].tolist())
    assert sum((Counter(langid.gram_keys([x])[0].tolist()) for x in held[:-2]), Counter()) == whole


def test_language_of_many_letters():
    keys, owner = langid.gram_keys(["ab 日本語", "日本 abc本", "x"])
    assert Counter(owner.tolist()) == Counter([0] * 2 + [0] * 1 + [0] * (3 + 2) + [1] * (2 + 1) + [1] * (3 + 2) + [1] * 1 + [2])
    assert len(set(keys.tolist()) & set(langid.gram_keys(["本語"])[0].tolist())) == 3


@pytest.fixture(scope="module")
def model():
    return public_tokenizers.path("piece_bpe_32k.model")


def test_segmentations(docs, empty, model):
    import sentencepiece

    made = segment.sample(docs, model, k=3).collect()
    by = defaultdict(list)
    for r in made:
        by[r.doc_id, r.n_pieces and r.sample].append(r)
        assert r.round_trip and r.log_prob - 5 < r.log_inclusion <= 0 and zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32
    processor = sentencepiece.SentencePieceProcessor(model_file=model)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in made:
        if r.doc_id in range(10) and r.ids:
            assert processor.decode(r.ids) == texts[r.doc_id]
    own = defaultdict(set)
    for r in made:
        if r.doc_id is not None and r.doc_id != 4:
            assert tuple(r.ids) not in own[r.doc_id]
            own[r.doc_id].add(tuple(r.ids))
    again = {(r.doc_id, r.sample): r.ids_crc32 for r in segment.sample(docs.where("doc_id < 20").repartition(5), model, k=3).collect()}
    assert all(again[r.doc_id, r.sample] == r.ids_crc32 for r in made if (r.doc_id, r.sample) in again)
    assert segment.sample(empty, model).count() == 0
    back = segment.decode(segment.sample(docs, model, k=2, keep=("doc_id", "text")).withColumnRenamed("text", "before"), model, keep=("doc_id", "before")).collect()
    assert back and all(r.text == (r.before or "") for r in back)
    odd = docs.sparkSession.createDataFrame([(1, None), (2, [-1]), (3, [10**6]), (4, []), (5, [None])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in segment.decode(odd, model).collect()} == {1: None, 2: None, 3: None, 4: "", 5: None}


def test_segmentations_are_drawn_without_replacement(model):
    """Against all segmentations of a short text: first samples follow their probabilities, pairs those of drawing without replacement."""
    v = segment.Vocabulary(model)
    pieces = {x: i for i, x in enumerate(v.bytes) if x and i >= 259}
    def every(text):
        return [[]] if not text else [[p, *rest] for n in range(1, len(text) + 1) if (p := text[:n]) in pieces for rest in every(text[n:])]
    paths = [tuple(pieces[p] for p in [*a, *b]) for a in every(b" the") for b in every(b" cat")]
    weight = np.exp([sum(v.weight[i] for i in p) for p in paths])
    p = dict(zip(paths, weight / weight.sum(), strict=True))
    first, second, n = Counter(), Counter(), 4000
    lattice = segment.Lattice([b"the cat"] * n, v)
    for a, b in lattice.samples(np.arange(n).astype(np.uint64) * np.uint64(7919), 2):
        first[tuple(lattice.ids[a[3]].tolist())] += 1
        second[tuple(lattice.ids[b[3]].tolist())] += 1
        assert a[1] >= b[1] and a[0] == pytest.approx(np.log(p[tuple(lattice.ids[a[3]].tolist())]), abs=1e-6)
    top = sorted(p, key=p.get, reverse=True)[:4]
    for x in top:
        assert first[x] / n == pytest.approx(p[x], abs=4 * (p[x] / n) ** 0.5 + 0.004)
        q = sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x)
        assert second[x] / n == pytest.approx(q, abs=4 * (q / n) ** 0.5 + 0.004)


def test_partial_matching(docs, rows, empty):
    learn = ~common.is_remainder("doc_id", 5, 1)
    found = ppm.score(docs, learn, keep=("doc_id", "score")).collect()
    low = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    train = [low(t) for i, t, *_ in rows if i is None or zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for t in train for w in words(t))
    n, kinds, ends = sum(c.values()) + len(train), len(c) + 1, len(train)
    log = lambda k: np.log10((k + 0.5) / (n + 0.5 * (kinds + 1)))
    expected = {}
    for i, t, *_ in rows:
        w = words(low(t))
        expected[i] = (len(w) + 1, sum(x in c for x in w) + 1, sum(log(c[x]) for x in w) + log(ends))
    for r in found:
        a, b, base = expected[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (a, b, n) and r.base_score == pytest.approx(base, rel=1e-9)
    # the trie's probabilities, by the definition
    def probability(history, symbol):
        excluded, p = set(), 1.0
        for k in range(ppm.ORDER, -1, -1):
            seen = followers[k].get(history[len(history) - k :], {})
            left = {s: m for s, m in seen.items() if s not in excluded}
            total = sum(left.values())
            if symbol in left:
                return p * (left[symbol] - 0.5) / total
            if left:
                p *= len(left) / (2 * total)
            excluded |= seen.keys()
        return p / (256 - len(excluded))
    followers = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    padded = lambda t: bytes([ppm.END]) * ppm.ORDER + low(t).encode() + bytes([ppm.END])
    for t in train:
        x = padded(t)
        for i in range(ppm.ORDER, len(x)):
            for k in range(ppm.ORDER, -1, -1):
                followers[k][x[i - k : i]][x[i]] += 1
                if followers[k][x[i - k : i]][x[i]] > 1:  # update exclusion
                    break
    texts = {i: t for i, t, *_ in rows}
    for r in found:
        if r.doc_id in (0, 1, 6, 100, 103, 106):
            x = padded(texts[r.doc_id])
            assert r.score == pytest.approx(sum(np.log10(probability(x[:i], x[i])) for i in range(ppm.ORDER, len(x))), rel=1e-6)
    adaptive = ppm.score(docs.where("doc_id in (0, 100)"), learn, mode="adaptive").collect()
    assert {r.doc_id: r.score for r in adaptive}[100] == pytest.approx(-np.log10(256)) and all(r.score < 0 for r in adaptive)
    assert ppm.score(empty, learn).count() == 0


def test_partial_matching_keeps_rare_contexts(spark):
    """What is seen once counts in a corpus of any size: 6 MB, where a share of 2e-7 is two occurrences."""
    rare = "the quokka jumped oddly by vexing zephyrs"
    own = [(i, "lorem ipsum dolor sit amet " * 40_000) for i in range(6)] + [(6, rare), (7, rare)]
    found = ppm.score(spark.createDataFrame(own, "doc_id long, text string"), F.col("doc_id") < 7).collect()
    assert {r.doc_id: r.score for r in found}[7] > -0.35 * len(rare)


def test_rules(docs, rows, empty):
    def base(t):
        w = words(t)
        runs = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if runs[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)
    counted = common.checkpointed(rules.features(docs))
    found = rules.judged(counted, min_group=5).collect()
    expected = {i: base(t) for i, t, *_ in rows}
    assert len(found) == len(rows)
    for r in found:
        n, *_, repeat = expected[r.doc_id]
        assert tuple(r[c] for c in rules.COUNTS) == expected[r.doc_id]
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)
    assert rules.judged(common.checkpointed(rules.features(empty))).count() == 0


def test_rules_reject_two_fifths_of_a_group(spark):
    """Symbol-heavy, of repeated lines, of repeated words, of long or of short words: each 40 % of a group of its own."""
    kinds = {"symbols": (100, 500, 60, 0, 5), "lines": (100, 500, 0, 40, 5), "repeats": (100, 500, 0, 0, 45), "long": (100, 1500, 0, 0, 5), "short": (100, 120, 0, 0, 5)}
    own = [(i, "en", kind, *(bad if i % 5 < 2 else (100, 480 + i % 40, i % 3, i % 2, i % 7))) for kind, bad in kinds.items() for i in range(300)]
    counted = spark.createDataFrame(own, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    found = rules.judged(common.checkpointed(counted)).collect()
    assert len(found) == 1500 and {(r.source, r.doc_id) for r in found if not r.kept} == {(kind, i) for kind in kinds for i in range(300) if i % 5 < 2}


def median(values):
    return sorted(map(stand_in, values))[(len(values) + 1) // 2 - 1]


def stand_in(x):
    """The value of a sketch's bucket."""
    return 2 * rules.GAMMA ** np.ceil(np.log(x) / np.log(rules.GAMMA)) / (rules.GAMMA + 1) if x > 0 else 0.0


def by_hand(values, error, scale):
    """(cut, fence where there is no cut) above, by trying every cut of the sorted values."""
    f, back = (np.sqrt, np.square) if scale == "sqrt" else (np.log, np.exp)
    x = sorted(map(stand_in, values))
    y = [float(f(v)) for v in x]
    at = lambda v, q: v[max(0, int(np.ceil(q * len(v) - 1e-9)) - 1)]
    rest = float(back(at(y, 0.5) + rules.REACH * (at(y, 0.5) - at(y, rules.FEW)))) if at(y, 0.5) > at(y, rules.FEW) else None
    for i in range(len(x) - 1):
        if x[i] < x[i + 1] and 2 * (i + 1) >= len(x):
            low, high = y[: i + 1], y[i + 1 :]
            if at(high, rules.FEW) - at(low, 1 - rules.FEW / 5) >= rules.WIDTH * np.hypot(np.std(low), error):
                return (x[i] * (rules.GAMMA + 1) / 2, rest)
    return (None, rest)


def test_rules_by_hand(spark):
    """kept, over groups and languages of many sizes, some with a class apart, against every cut tried in turn."""
    rng = np.random.default_rng(11)
    own = []
    for lang, source, n, bad in (("en", "a", 400, 0.3), ("en", "b", 250, 0.0), ("en", "c", 60, 0.1), ("de", "a", 150, 0.05), ("de", None, 100, 0.0), (None, "a", 30, 0.5), ("fr", "z", 220, 0.02)):
        for _ in range(n):
            words, junk = int(rng.integers(60, 400)), rng.random() < bad
            own.append((len(own), lang, source, words, int(words * rng.normal(9 if junk else 5, 0.3)), int(words * 0.5) if junk else int(rng.random() < 0.02), int(rng.random() < 0.1), int(6 * (rng.random() < 0.2))))
    own += [(len(own), "en", "a", 0, 0, 0, 0, 0), (len(own) + 1, "en", "a", 300, 1500, 0, 0, 290)]
    names = ("doc_id", "lang", "source", *rules.COUNTS)
    df = spark.createDataFrame(own, "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long")
    found = {r.doc_id: r for r in rules.judged(common.checkpointed(df)).collect()}
    rows = [dict(zip(names, r, strict=True)) for r in own]
    share = {"word_length": "word_chars", "symbol_share": "n_symbols", "dup_line_share": "n_dup_lines", "repeat_share": "n_repeat_words"}
    hand, values = {}, {}
    for r in rows:
        for group in ((r["lang"], r["source"]), (r["lang"],), ()):
            values.setdefault(group, []).append(r)
    for group, members in values.items():
        members = [r for r in members if r["n_words"]]
        size = median([r["n_words"] for r in members])
        for m, (_, unit, scale, low) in rules.MEASURES.items():
            x = [r[share[m]] / r["n_words"] for r in members]
            hand[group, m] = (len(members), median(x), by_hand(x, np.sqrt(unit / size) / 2, scale), by_hand([1 / v for v in x], np.sqrt(unit / size) / 2, scale) if low else None)
    def limit(levels, side, beyond):
        own = levels[0][1]
        return next((x[side][0] for x in levels if x[side][0] is not None and beyond(own, x[side][0])), next((x[side][1] for x in levels if x[side][1] is not None), None))
    rejected = 0
    for r in rows:
        base = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        bad = base
        for m, (*_, low) in rules.MEASURES.items():
            if r["n_words"]:
                groups = [hand[g, m] for g in ((r["lang"], r["source"]), (r["lang"],), ())]
                levels = [g for g in groups[:2] if g[0] >= rules.MIN_GROUP] + groups[2:]
                levels = [(n, groups[0][1], up, down) for n, _, up, down in levels]
                x = r[share[m]] / r["n_words"]
                top = limit(levels, 2, lambda own, f: own <= f)
                bad |= top is not None and x > top
                if low:
                    floor = limit(levels, 3, lambda own, f: 1 / own <= f * (1 + 2 * rules.GAMMA))
                    bad |= floor is not None and 1 / x > floor * (1 + 1e-9)
        got = found[r["doc_id"]]
        assert (got.base_failed, got.kept) == (base, not bad), r
        rejected += bad and not base
    assert 100 < rejected < 200


def test_perplexity_rejects_two_fifths_of_a_language(spark):
    own = [(i, "en", 40.0 if i % 5 < 2 else 5 + i % 10 / 10) for i in range(300)]
    found = kneser_ney.judged(common.checkpointed(spark.createDataFrame(own, "doc_id long, lang string, perplexity double"))).collect()
    assert {r.doc_id for r in found if not r.kept} == {i for i in range(300) if i % 5 < 2}


def test_fences_follow_quantiles(spark):
    rng = np.random.default_rng(1)
    values = rng.lognormal(1, 0.5, 3000)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    parts = [df.where(f"i % 2 = {k}").groupBy(rules.bucket(F.col("v")).alias("bucket")).agg(F.count("*").alias("n")) for k in (0, 1)]
    merged = parts[0].union(parts[1]).groupBy("bucket").agg(F.sum("n").alias("n")).orderBy("bucket").toPandas()
    x, n = rules.middle(merged["bucket"].to_numpy()), merged["n"].to_numpy()
    assert n.sum() == 3000
    for q in (0.05, 0.5, 0.95):
        assert rules.quantile(x, n, q) == pytest.approx(np.quantile(values, q), rel=0.02)


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 32)).astype(np.float32)
    x[7] = x[100]
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)] + [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] * 32), (2003, [None] * 32), (2004, [1.0]), (2100, [1.0, 2.0]), (2101, [1.0, 4.0]), (None, [1.0] * 32)]
    rows += [(i, v, ) for i, v in rows[200:203]]  # repeated rows
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, score string")
    found = mih.search(df, F.col("vec_id") % 100 == 0, sample=500, shard=400, block=4).collect()
    hit = 0
    for q in range(0, 1500, 100):
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [a for a, *_ in own] == list(range(1, 11))
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        best = [j for i in np.lexsort((np.arange(1500), d)) if i != q for j in [i] * (1 + (200 <= i < 203))][:10]
        hit += len({i for _, i, _ in own} & set(best))
        assert all(s == pytest.approx(d[i]) for _, i, s in own) and [s for *_, s in own] == sorted(s for *_, s in own)
    assert hit >= 0.9 * 150
    assert {r.query_id for r in found} == set(range(0, 1500, 100)) | {2100}
    assert [(r.rank, r.vec_id, r.score) for r in found if r.query_id == 2100] == [(1, 2101, 2.0)]
    few = mih.search(df.where("vec_id < 5"), F.col("vec_id") == 0).collect()
    assert len(few) == 4
    assert mih.search(df.where("vec_id < 0"), F.col("vec_id") == 0).count() == 0


def test_pigeonhole_finds_every_code():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 16, (3000, 8)).astype(np.uint16)
    codes[:500] = codes[0] ^ (np.uint16(1) << rng.integers(0, 16, (500, 8)).astype(np.uint16))
    index = mih.Index(np.arange(3000), np.zeros((3000, 1)), codes)
    bits = np.unpackbits(codes.view(np.uint8), axis=1).astype(int)
    for radius in (0, 5, 16, 31, 50, 128):
        assert index.within(codes[3], radius).tolist() == np.flatnonzero((bits != bits[3]).sum(axis=1) <= radius).tolist()


def test_kneser_ney(spark, docs, empty):
    trusted = spark.createDataFrame([(i,) for i in range(0, 40)], "doc_id long")
    found = kneser_ney.perplexities(docs, trusted, keep=("doc_id", "lang"))
    found = {r.doc_id: r for r in kneser_ney.judged(common.checkpointed(found), min_group=10).collect()}
    assert all(found[i].perplexity is None and not found[i].kept for i in (100, 101, 102))
    assert found[103].perplexity > 5 * found[0].perplexity and found[0].is_trusted and not found[50].is_trusted
    # probabilities by the definition, and that they sum to one
    texts = [r.text.encode() for r in docs.where("doc_id between 0 and 39").collect()]
    n = kneser_ney.ORDER
    counts = [None] * (n + 1)
    def runs(t):
        x = b"\xff" * (n - 1) + t + b"\xff"
        return [x[i : i + n] for i in range(len(t) + 1)]
    counts[n] = Counter(g for t in texts for g in runs(t))
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    d = [None, *(kneser_ney.discounts([sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]) for k in range(1, n + 1))]
    by = [defaultdict(list) for _ in range(n + 1)]
    for k in range(1, n + 1):
        for g, c in counts[k].items():
            by[k][g[:-1]].append(c)
    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / 256
        own = by[k].get(gram[:-1])
        if not own:
            return lower
        cut = lambda c: d[k][min(c, 3) - 1]
        c = counts[k].get(gram, 0)
        return (max(c - cut(c), 0) if c else 0) / sum(own) + sum(map(cut, own)) / sum(own) * lower
    for i in (0, 41, 103):
        text = docs.where(f"doc_id = {i}").first().text.encode()
        assert found[i].perplexity == pytest.approx(np.exp(-np.mean([np.log(p(g)) for g in runs(text)])), rel=1e-4)
    context = next(iter(by[n]))
    assert sum(p(context + bytes([s])) for s in range(256)) == pytest.approx(1)
    # thresholds by hand
    values = defaultdict(list)
    for r in found.values():
        if r.perplexity is not None:
            values[r.lang].append(r.perplexity)
            values["all"].append(r.perplexity)
    hand = {x: by_hand(v, np.log(rules.GAMMA), "log") for x, v in values.items()}
    for r in found.values():
        levels = [hand[r.lang]] * (len(values.get(r.lang, [])) >= 10) + [hand["all"]]
        limit = next((x[0] for x in levels if x[0] is not None and median(values.get(r.lang, values["all"])) <= x[0]), levels[0][1])
        assert r.threshold == pytest.approx(limit) and r.kept == (r.perplexity is not None and r.perplexity <= limit)
    assert kneser_ney.perplexities(empty, trusted).count() == 0


def cut_lines(rows, span=2, divisor=2, bits=64):
    """Line dedup by brute force on the operator's chunks."""
    unique = {}
    for i, t, *_ in rows:
        unique[(i is not None, i or 0, t or "")] = (i, t)
    def first_key(i, t, number):
        data = (("\1" if i is None else str(i)) + "\0" + (t or "")).encode()
        return (i is not None, i or 0, hashlib.md5(data).digest(), number)
    seen = defaultdict(list)
    for i, t in unique.values():
        c = linechunks.Chunks([(t or "").encode()], span, divisor)
        for k in range(len(c.lines)):
            if c.multi[k]:
                seen[c.bytes(k)].append((first_key(i, t, k), (i, t, k)))
    gone = {place for v in seen.values() for _, place in sorted(v, key=lambda x: x[0])[1:]}
    out = {}
    for i, t in unique.values():
        if t is None:
            out[i, t] = None
            continue
        c, lines, kept, at = linechunks.Chunks([t.encode()], span, divisor), t.split("\n"), [], 0
        for k, size in enumerate(c.lines.tolist()):
            if (i, t, k) not in gone:
                kept += lines[at : at + size]
            at += size
        out[i, t] = "\n".join(kept)
    return out


@pytest.mark.parametrize("hash_bits", [64, 3])
def test_line_chunks(docs, rows, empty, hash_bits):
    found = linechunks.dedup(docs.withColumn("before", F.col("text")), hash_bits=hash_bits).collect()
    expected = cut_lines(rows)
    assert len(found) == len(rows)
    for r in found:
        assert r.text == expected[r.doc_id, r.before]
        assert r.n_removed_lines <= r.n_lines
    if hash_bits == 64:
        assert sum(r.n_removed_lines > 0 for r in found) >= 2
        assert linechunks.dedup(empty).count() == 0


def test_chunks_move_with_their_lines():
    lines = [f"line {i} {i * 7919 % 101}".encode() for i in range(200)]
    a, b = linechunks.Chunks([b"\n".join(lines)]), linechunks.Chunks([b"\n".join([b"new", *lines])])
    of = lambda c: {c.bytes(i) for i in range(len(c.lines))}
    assert len(of(a) - of(b)) <= 2


def test_chunk_boundaries_by_the_definition():
    """A chunk ends at the text's end, or at a line where the rolling hash of it and the line before is even, if it has two lines."""
    rng = random.Random(9)
    texts = [b"\n".join(rng.choice([b"", b"a", b"some line", b"another much longer line of text"]) + str(rng.randint(0, 3)).encode() * rng.randint(0, 1) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    c = linechunks.Chunks(texts)
    for i, t in enumerate(texts):
        lines, expected, held, before = t.split(b"\n"), [], [], None
        for k, line in enumerate(lines):
            h = common.hashed(np.frombuffer(line, np.uint8), np.array([0]), np.array([len(line)]))[0, 0]
            with np.errstate(over="ignore"):
                roll = common.mixed(np.array([h + (np.uint64(3) * before if before is not None else np.uint64(0))]))[0]
            held.append(line)
            before = h
            if k == len(lines) - 1 or int(roll) % 2 == 0 and len(held) > 1:
                expected.append(b"\n".join(held))
                held = []
        assert [c.bytes(k) for k in np.flatnonzero(c.owner == i)] == expected
        assert [bool(c.multi[k]) for k in np.flatnonzero(c.owner == i)] == [sum(bool(x.strip()) for x in e.split(b"\n")) > 1 for e in expected]


def test_hashes_of_alike_words():
    """Thue-Morse words, on which polynomial hashes modulo a power of two agree: each operator tells them apart."""
    def morse(n, a, b):
        x = a
        y = b
        while len(x) < n:
            x, y = x + y, y + x
        return x
    import tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    reference, encoder = tokenizers.Tokenizer.from_file(vocabulary), packing.Encoder(vocabulary)
    for n in (1024, 2048):
        a, b = morse(n, "a", "b"), morse(n, "b", "a")
        text = f"x {a} y {b} z"
        ids, _ = encoder.batch([text.encode()], 0)
        assert ids.tolist() == [*reference.encode(text, add_special_tokens=False).ids, 0]
        w = common.Words([text.encode()])
        assert len(np.unique(w.h, axis=0)) == 5
        one, two = (lshforest.shingles([" ".join([x] * 5).encode()])[0] for x in (a, b))
        assert one.tolist() != two.tolist()
        v = segment.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
        lattice = segment.Lattice([text.encode()], v)
        assert v.decode(lattice.ids[lattice.samples(np.array([1], np.uint64), 1)[0][0][3]]) == text.encode()
    for n in range(17):  # equal hashes for equal bytes only
        x = np.frombuffer(bytes(range(n)) + b"\0" * 20, np.uint8)
        assert len(np.unique(common.hashed(x, np.zeros(16, np.int64), np.arange(16)), axis=0)) == 16


def test_packing(docs, rows, empty):
    import tokenizers

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    reference = tokenizers.Tokenizer.from_file(vocabulary)
    extra = ["a <|endoftext|> b", " x", "x ", "a\n b  c", "it's    q　 z é", "   ", "é é", "かな かな", "a\u0085 b"]
    encoder = packing.Encoder(vocabulary)
    ids, offsets = encoder.batch([x.encode() for x in extra], 0)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [[*e.ids, 0] for e in reference.encode_batch(extra, add_special_tokens=False)]
    long = " ".join(extra * 40) + "x" * 3000 + " and é the end"
    assert encoder.long(long.encode(), 0, 500).tolist() == [*reference.encode(long, add_special_tokens=False).ids, 0]
    found = packing.pack(docs, vocabulary, emit_ids=True, block_tokens=5000).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and (at == 1024 or at & (at - 1) == 0)  # no padding at all
    texts = {i: t for i, t, *_ in rows}
    for i, own in documents.items():
        if i == 4:  # a repeated row
            continue
        joined = [x for r in sorted(own, key=lambda r: r.start) for x in r.ids]
        assert joined == [*reference.encode(texts[i] or "", add_special_tokens=False).ids, 0] and own[0].doc_tokens == len(joined)
    assert packing.pack(empty, vocabulary).count() == 0


def test_packing_is_balanced():
    rng = random.Random(1)
    lengths = [rng.choice([50, 200, 700, 1000, 1500]) for _ in range(400)]
    cost, filled = Counter(), Counter()
    for _, _, n, q, _ in packed(lengths):
        cost[q] += packing.cost(n)
        filled[q] += n
    # by brute force: the cheapest of all sequences with room for a rest; if there is none, the cheapest with any
    rests = sorted(((n % 1024, d) for d, n in enumerate(lengths) if n % 1024), key=lambda x: (-x[0], x[1]))
    room = packing.capacities(sum(n for n, _ in rests))
    left, paid, first, expected = list(room), [0.0 if r == 1024 else packing.LAST for r in room], sum(n // 1024 for n in lengths), []
    for n, d in rests:
        start = lengths[d] - n
        while n:
            i = min((i for i in range(len(room)) if left[i] >= n), key=lambda i: (paid[i], i), default=None)
            i = min((i for i in range(len(room)) if left[i]), key=lambda i: (paid[i], i)) if i is None else i
            part = min(n, left[i])
            expected.append((d, start, part, first + i, room[i] - left[i]))
            left[i], paid[i], start, n = left[i] - part, paid[i] + packing.cost(part), start + part, n - part
    assert [x for x in packed(lengths) if x[3] >= first] == expected
    whole = [cost[q] for q in filled if filled[q] == 1024]
    assert sum(filled.values()) == sum(lengths) and max(whole) <= 2.1 * min(whole)


packed = packing.packed


@pytest.mark.parametrize("width,anchor,bits", [(35, 8, None), (6, 3, 20)])
def test_repeated_windows(docs, rows, empty, width, anchor, bits):
    n = Counter(tuple(w[i : i + width]) for _, t, *_ in rows for w in (words(t),) for i in range(len(w) - width + 1))
    expected = defaultdict(list)
    for i, t, *_ in rows:
        w = words(t)
        gone = {j for k in range(len(w) - width + 1) if n[tuple(w[k : k + width])] > 1 for j in range(k, k + width)}
        expected[i].append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    found = substrings.dedup(docs, width=width, anchor=anchor, width_bits=bits).collect()
    assert len(found) == len(rows)
    assert all((r.n_words, r.n_removed, r.kept_text) in expected[r.doc_id] for r in found)
    assert any(0 < r.n_removed < r.n_words for r in found)
    assert substrings.dedup(empty).count() == 0


def test_sketch_overestimates():
    """Whatever repeats, within a bundle or over bundles, is estimated so, whatever the sketch's size."""
    rng = random.Random(6)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(400)).encode() for _ in range(6)]
    texts[3] = texts[0][:900] + texts[3]
    bundles = [substrings.Spans(texts[i : i + 2], 10, 4) for i in (0, 2, 4)]
    for bits in (16, 18, 20):
        anchors = [substrings.Anchors(x, bits) for x in bundles]
        by, told = defaultdict(lambda: ([], [])), [{} for _ in bundles]
        for i, own in enumerate(anchors):
            for shard, data in own.questions():
                by[shard][0].append(i)
                by[shard][1].append(data)
        for shard, (who, data) in by.items():
            for batch in substrings.merged(shard, who, data):
                for i, answer in zip(batch.column("bundle").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    told[i][shard] = answer
        n = Counter(x for own in anchors for x in own.runs.tolist())
        found = [set(own.repeated(answers).tolist()) for own, answers in zip(anchors, told, strict=True)]
        assert any(c > 1 for c in n.values()) and all(x in f for own, f in zip(anchors, found, strict=True) for x in own.runs.tolist() if n[x] > 1)


def test_repeated_windows_of_long_texts(spark):
    """Texts that are worked on in several pieces."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    long = [word() for _ in range(700_000)]
    shared = long[149_700:150_200]
    own = [(1, " ".join(long)), (2, " ".join([*(word() for _ in range(50)), *shared, *(word() for _ in range(50))]))]
    found = {r.doc_id: r for r in substrings.dedup(spark.createDataFrame(own, "doc_id long, text string")).collect()}
    assert found[1].n_removed == found[2].n_removed == 500 and found[1].n_words == 700_000
    assert found[1].kept_text == " ".join(long[:149_700] + long[150_200:])


def test_near_duplicates(docs, rows, empty):
    sets = {}
    for i, t, *_ in rows:
        w = words(t)
        sets[i, t] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    distinct = sorted({s for s in sets.values() if s}, key=lambda s: min(map(str, s)))
    near = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    links = {s: {o for o in distinct if o is not s and near(s, o)} for s in distinct}
    def group(s):
        out, todo = {s}, [s]
        while todo:
            for o in links[todo.pop()] - out:
                out.add(o)
                todo.append(o)
        return out
    least = lambda ids: None if any(i is None for i in ids) else min(ids)
    texts = {i: t for i, t, *_ in rows}
    for block in (1024, 3):
        for r in lshforest.groups(docs, block=block).collect():
            s = sets[r.doc_id, texts[r.doc_id]]
            if s is None:
                assert r.class_id == r.doc_id and r.n_links == 0
                continue
            own = group(s)
            assert r.n_links == len(links[s])
            assert r.class_id == least([i for (i, _), o in sets.items() if o in own])
    kept = lshforest.kept(docs)
    ids = [r.doc_id for r in kept.collect()]
    assert 4 in ids and ids.count(4) == 1 and 10 not in ids and 12 not in ids and {100, 101, 102} <= set(ids) and None in ids
    assert lshforest.groups(empty).count() == 0 and lshforest.kept(empty).count() == 0


def test_groups_whose_ids_are_null_or_repeat_keep_one_row_each(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    own = [(None, text("a")), (1, text("a")), (None, text("b")), (2, text("b")), (7, text("c")), (8, text("c")), (7, text("d")), (9, text("d")), (3, text("e"))]
    kept = lshforest.kept(spark.createDataFrame(own, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (3, text("e"))])


def test_forest_shortens_to_its_target():
    k = lshforest.prefix_length(0.8, 24, 8, 0.999)
    assert 1 - (1 - 0.8**k) ** 24 >= 0.999 > 1 - (1 - 0.8 ** (k + 1)) ** 24
    n = lshforest.enough(24, 0.999)
    assert 1 - (1 - n / 24) ** 24 >= 0.999 > 1 - (1 - (n - 1) / 24) ** 24


def test_questions_come_back_in_their_order():
    rng = np.random.default_rng(12)
    keys = np.unique(rng.integers(0, 1 << 63, 1000).astype(np.uint64))
    arrays = [keys, rng.integers(0, 9, 1000).astype("<u4"), rng.random(7).astype("<f4"), np.empty(0, np.int64), np.arange(5, dtype=np.uint8)]
    back = exchange.load(exchange.dump(*arrays))
    assert all(a.dtype == b.dtype and (a == b).all() for a, b in zip(arrays, back, strict=True)) and len(back) == len(arrays)
    groups = np.sort(rng.integers(0, 50, 1000).astype(np.uint64))
    order, asked, borders = exchange.placed(groups, 7)
    assert sorted(order.tolist()) == list(range(1000)) and borders[0] == 0 and borders[-1] == 1000
    of = {}
    for shard, a, b in zip(asked.tolist(), borders[:-1], borders[1:], strict=True):
        own = order[a:b]
        assert (np.diff(own) > 0).all()
        for g in set(groups[own].tolist()):
            assert of.setdefault(g, shard) == shard  # all keys of a group go to one shard
    places = common.Places(keys)
    some = rng.choice(keys, 5000)
    assert (keys[places.of(some)] == some).all() and len(places.of(keys[:0])) == 0


def test_a_repeated_query_asks_with_its_least_vector(spark):
    """Whatever the partitions, of a query id's vectors the least is looked for."""
    rng = np.random.default_rng(17)
    own = [(i, (rng.standard_normal(8)).tolist()) for i in range(300)]
    own += [(0, (own[0][1][0] + d, *own[0][1][1:])) for d in (-3.0, 2.0, -1.0)]
    least = np.array(min(tuple(v) for i, v in own if i == 0))
    others = sorted((float(np.sqrt(((np.array(v) - least) ** 2).sum())), i) for i, v in own if i)[:10]
    df = spark.createDataFrame([(i, list(v)) for i, v in own], "vec_id long, embedding array<double>")
    for parts in (1, 3, 7):
        found = mih.search(df.repartition(parts), F.col("vec_id") == 0).orderBy("rank").collect()
        assert len(found) == 10 and found[0].score == pytest.approx(others[0][0])
        assert len({r.vec_id for r in found} & {i for _, i in others}) >= 9


def test_the_query_gives_the_pieces_of_each_segmentation(spark):
    from graphloom.llm import queries

    rows = queries.op2_gumbel_segmentations(spark, "/root/testdata/sf0.001").where("doc_id < 40").collect()
    assert rows and all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32 for r in rows)


def test_kneser_ney_learns_from_all_that_are_trusted(spark):
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit("ab").alias("text")).repartition(4)
    found = kneser_ney.perplexities(docs, docs.where("doc_id <> 7").unionByName(docs.where("doc_id < 3")).select("doc_id"))
    assert {(r.is_trusted, r["count"]) for r in found.groupBy("is_trusted").count().collect()} == {(True, 20_999), (False, 1)}


def spoken(rng, n):
    return " ".join("".join(rng.choice("aaeeinorstué日 ") for _ in range(rng.randint(1, 9))) for _ in range(n)).encode()


def test_segmentations_of_a_text_are_the_same_wherever_it_stands(model):
    rng, v = random.Random(5), segment.vocabulary_of(model)
    texts = [b"", *(spoken(rng, rng.choice([1, 3, 40, 2000])) for _ in range(40))]
    seeds = np.arange(len(texts)).astype(np.uint64) * np.uint64(7919)
    lattice = segment.Lattice(texts, v)
    among = [[(*x[:3], lattice.ids[x[3]].tolist()) for x in found] for found in lattice.samples(seeds, 3)]
    assert among == [[(*x[:3], lattice.ids[x[3]].tolist()) for x in found] for a in (0, 25) for found in lattice.samples(seeds[a : a + 25], 3, a)]
    for i, text in enumerate(texts):
        own = segment.Lattice([text], v)
        assert [(*x[:3], own.ids[x[3]].tolist()) for x in own.samples(seeds[i : i + 1], 3)[0]] == among[i]


def test_malformed_texts_are_segmented_whole(model):
    v = segment.vocabulary_of(model)
    texts = [b"\xff\xfe a b", b"ab\xf0", b"\x80\x80 x", b"a\xe2\x96", b"\xf0\xe2 the"]
    lattice = segment.Lattice(texts, v)
    for text, found in zip(texts, lattice.samples(np.arange(len(texts)).astype(np.uint64), 3), strict=True):
        assert all(v.decode(lattice.ids[x[3]]) == text for x in found)


def test_words_of_runs_of_texts_are_built_once(model):
    rng, v = random.Random(6), segment.vocabulary_of(model)
    text = spoken(rng, 60_000)
    texts = [text] * (segment.SHARED // len(text))
    found = list(segment.sampled(texts, np.arange(len(texts)).astype(np.uint64), v, 1))
    assert len(texts) > 3 and len(found) > 1 and len({id(lattice) for _, lattice, _ in found}) == 1
    assert [i for own, *_ in found for i in range(own.start, own.stop)] == list(range(len(texts)))
    assert all(v.decode(lattice.ids[made[0][3]]) == text for _, lattice, its in found for made in its)


def test_the_best_regions_are_among_the_candidates(model, monkeypatch):
    """Against regions at every place, for texts far longer than the bound and vocabularies of sharp and flat weights."""
    rng = random.Random(7)
    texts = [spoken(rng, n) for n in (1, 5, 50, 500, 3000, 3000, 3000)] + [b"e " * 4000, "é".encode() * 900]
    for alpha in (0.2, 1.0, 3.0):
        v = segment.Vocabulary(model, alpha)
        lattice = segment.Lattice(texts, v)
        for seed in range(6):
            seeds = common.mixed(np.arange(len(texts)).astype(np.uint64) + np.uint64(100 * seed))
            found = [[(*x[:3], x[3].tolist()) for x in its] for its in lattice.samples(seeds, 5)]
            with monkeypatch.context() as m:
                m.setattr(segment.Lattice, "_candidates", lambda self, flat, before, start, size, t, most: (np.arange(len(flat)), size))
                assert found == [[(*x[:3], x[3].tolist()) for x in its] for its in lattice.samples(seeds, 5)]


def test_the_double_array_finds_every_piece(model):
    rng, v = random.Random(8), segment.vocabulary_of(model)
    pieces = {x: i for i, x in enumerate(v.bytes) if x and i >= 259}
    text = b" the international Zusammenarbeit \xe6\x97\xa5\xe6\x9c\xac 12345 \n\t" + spoken(rng, 300)
    data = np.append(np.frombuffer(text, np.uint8).astype(np.int32), np.int32(segment.STOP))
    found = {(p, n): i for n, at, ids in v.matches(data) for p, i in zip(at.tolist(), ids.tolist(), strict=True)}
    longest = max(map(len, pieces))
    assert found == {(p, n): pieces[text[p : p + n]] for p in range(len(text)) for n in range(1, min(longest, len(text) - p) + 1) if text[p : p + n] in pieces}
