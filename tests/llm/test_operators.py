"""The corpus operators against brute force, and on awkward tables."""

from __future__ import annotations

import math
import random
import re
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from oriel.llm import chat, fingerprint, kernel, langid, mixing, ngram_join, packing, pii, substring, tokens, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = {c: "x" for c in ("anchor", "block", "node", "rid", "place", "tokens", "window", "rank", "score", "sketch", "value", "keep", "h1", "component")}


def words_of(text):
    return [w.lower() for w in re.split(r"[ \t\n\f\r]+", text or "") if w]


def vocabulary(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def corpus(seed=1, n=60, size=90):
    """Random documents with copies, near copies and shared passages."""
    rng, words = random.Random(seed), vocabulary(seed, 400)
    docs = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(1, size))]
        if i % 7 == 1 and docs:
            own = words_of(docs[-1][1])
        elif i % 7 == 2 and docs:
            own = words_of(docs[-1][1])
            own = [w if rng.random() > 0.05 else rng.choice(words) for w in own]
        elif i % 7 == 3 and docs:
            own = own + words_of(docs[0][1])[:60] + own[:10]
        docs.append((i, " ".join(own), ["en", "de"][i % 2], f"src{i % 4}", 0))
    return docs


def awkward(spark, extra=True):
    long = " ".join(vocabulary(9, 300) * 40)
    rows = [*corpus(3, 20), (None, "no id here at all", "en", "src0", 1), (100, None, "en", "src0", 1), (101, "", None, None, 1), (102, " \n\t", "en", None, 1), (103, long, "en", "src1", 1), (104, long, "en", "src1", 1), (105, "Word", "en", "src2", 1), (105, "Word", "en", "src2", 1), (106, "x" * 50_000, "en", "src2", 1), (107, "ÀÉ ñ 漢字 🙂", None, "src9", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in CLASHES.items()}) if extra else df


def frame(spark, docs):
    return spark.createDataFrame(docs, SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- substring deduplication -------------------------------------------------------------------


def brute_passages(docs, width):
    places = defaultdict(list)
    for n, (i, text, *_) in enumerate(docs):
        if i is None or text is None:
            continue
        w = words_of(text)
        for p in range(len(w) - width + 1):
            places[tuple(w[p : p + width])].append((i, n, p))
    own = defaultdict(list)
    for found in places.values():
        if len(found) > 1:
            for i, _, p in found:
                own[i].append((p, len(found)))
    out = []
    for i, hits in own.items():
        begin = end = None
        for p, copies in sorted(hits):
            if end is None or p > end:
                if end is not None:
                    out.append((i, begin, end, most))
                begin, most = p, 0
            end, most = max(end or 0, p + width), max(most, copies)
        out.append((i, begin, end, most))
    return sorted(out)


@pytest.mark.parametrize("width", [8, 25])
def test_repeated_passages(spark, width):
    docs = [*corpus(5), (500, "a b " * 60, "en", "s", 0), (501, None, "en", "s", 0), (502, "", "en", "s", 0)]
    got = substring.repeated_passages(frame(spark, docs), width)
    assert sorted(rows(got.select("doc_id", "start_word", "end_word", "copies"))) == brute_passages(docs, width)


def test_hot_anchors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(substring, "ANCHORS_PER_BLOCK", 8)
    docs = [*corpus(5), *[(300 + i, " ".join(vocabulary(3, 40)) + f" n{i}", "en", "s", 0) for i in range(60)]]
    got = substring.repeated_passages(frame(spark, docs), 8, hot=1)
    assert sorted(rows(got.select("doc_id", "start_word", "end_word", "copies"))) == brute_passages(docs, 8)


def test_anchors_do_not_depend_on_what_stands_around():
    rng = random.Random(4)
    own = [rng.choice("abcdefg") for _ in range(70)]
    for before in (0, 1, 500):
        w = kernel.Words(pa.array([" ".join([rng.choice("xyz") for _ in range(before)] + own)]))
        at, place, _ = substring.anchor_of_windows(w, 20)
        assert len(at) == before + 51
        places = [int(p) - before for a, p in zip(at, place, strict=True) if a >= before]
        first = places if not before else first
        assert places == first


def test_repeated_rows_are_places_of_their_own(spark):
    text = " ".join(vocabulary(2, 30))
    got = rows(substring.repeated_passages(frame(spark, [(1, text, "en", "s", 0)] * 2), 10).select("doc_id", "start_word", "end_word", "copies"))
    assert got == [(1, 0, 30, 2)]


def test_count_min_never_underestimates():
    rng = np.random.default_rng(0)
    hashes = kernel.mix(rng.integers(0, 3000, 9000).astype(np.uint64))
    parts = [substring.partition_sketch(p, 1) for p in np.array_split(hashes, 3)]
    unique, count = np.unique(hashes, return_counts=True)
    assert (substring.estimates(unique, [(c, n) for _, c, n in parts]) >= np.minimum(count, 255)).all()


# ---- toxicity ----------------------------------------------------------------------------------


def toxic_corpus(n=360):
    rng, words = random.Random(4), vocabulary(4, 300)
    docs, labels = [], []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        bad = i % 3 == 0
        if bad:
            for _ in range(3):
                own[rng.randrange(len(own))] = rng.choice(["zzgrub", "zzgrubby", "qwlout"])
        docs.append((i, " ".join(own), ["en", "de"][i % 2], "s", 0))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_corpus()
    model = toxicity.fit(frame(spark, docs[:240]), spark.createDataFrame(labels[:240], "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r.toxic for r in toxicity.classify(frame(spark, docs[240:]), model).collect()}
    right = sum(got[i] == bool(t) for i, _, t in labels[240:])
    assert right / len(got) >= 0.95


def test_thresholds_from_all_labelled_rows(spark):
    """Against loops; few toxic documents are left over by training, and one language is rare."""
    rng = random.Random(6)
    rows = [(i, "xx" if i % 50 == 0 else rng.choice(["en", "de", None]), rng.choice([0.0, *[round(rng.random(), 2)] * 9]), rng.random() < 0.15) for i in range(4000)]
    trained = [i for i, _, _, y in rows if (y and i % 4) or i % 11 == 0]
    known = spark.createDataFrame([(i, int(y)) for i, _, _, y in rows], "doc_id long, toxic int")
    got = toxicity.calibrate(spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, score double"), known, [])
    part = toxicity.calibrate(spark.createDataFrame([r[:3] for r in rows], "doc_id long, lang string, score double"), known, trained)
    for limits, left_out in ((got, set()), (part, set(trained))):
        for lang in (None, "en", "de", "xx"):
            own = [(i, s, y) for i, x, s, y in rows if s > 0 and lang in (None, x)]
            held = [r for r in own if r[0] not in left_out]
            weight = {c: sum(y == c for *_, y in own) / max(1, sum(y == c for *_, y in held)) for c in (False, True)}
            if lang and min(sum(y == c for *_, y in held) for c in (False, True)) < toxicity.LEAST_HELD:
                assert lang not in limits
                continue
            steps = sorted({s for _, s, _ in held}, reverse=True)
            f1 = []
            for at in steps:
                hit, miss = (sum(weight[c] for _, s, y in held if s >= at and y == c) for c in (True, False))
                f1.append(2 * hit / (hit + miss + sum(y for *_, y in own)))
            i = max(range(len(steps)), key=lambda j: (round(f1[j], 9), steps[j]))
            assert limits[lang] == pytest.approx((steps[i] + [*steps, 0][i + 1]) / 2)


def test_rare_language_has_a_threshold_of_its_own(spark):
    """The sample of training holds nearly nothing of it, the labels enough."""
    docs, labels = toxic_corpus(1200)
    docs = [(i, text, "xx" if i % 20 < 2 else "en", s, n) for i, text, _, s, n in docs]
    model = toxicity.fit(frame(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), per_class=40)
    assert {None, "en", "xx"} == set(model.limits)


def test_pooling_against_loops():
    rng = np.random.default_rng(1)
    model = toxicity.Model(rng.normal(size=(toxicity.BUCKETS, toxicity.SIZE)).astype(np.float32), rng.normal(size=(toxicity.SIZE, sum(toxicity.WIDTHS) * toxicity.FILTERS)).astype(np.float32), np.zeros(len(toxicity.WIDTHS) * toxicity.FILTERS, np.float32), np.ones(len(toxicity.WIDTHS) * toxicity.FILTERS, np.float32), 0.0)
    w = kernel.Words(pa.array(["one two three four", "", "five", "one two"]))
    kind, own, bound = toxicity.features(w)
    x = toxicity.embed(model, own, bound)
    got = toxicity.pooled(model, x @ model.filters, kind, w.bound)
    for d in range(4):
        seq = x[kind[w.bound[d] : w.bound[d + 1]]]
        for i, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = max((sum(float(seq[p + j] @ model.filters[:, toxicity._columns(width, j).start + f]) for j in range(width) if p + j < len(seq)) for p in range(len(seq))), default=0)
                assert got[d, i * toxicity.FILTERS + f] == pytest.approx(max(best, 0), abs=1e-3)


def test_toxicity_without_labels(spark):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.classify(awkward(spark), toxicity.fit(awkward(spark), empty)).collect()
    assert got and all(r.score == 0 and not r.toxic for r in got)


# ---- chat --------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "Hi <|im_end|> there\n"), (1, 1, "assistant", "Bien sûr! <\\|x 🙂"), (1, 1, "assistant", "Bien sûr! <\\|x 🙂"), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "assistant", "ok"), (3, 2, "user", "z" * 25_000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(said, "conv_id long, turn long, role string, text string").withColumn("tokens", F.lit(1))).collect()}
    assert set(got) == {1, 2, 3} and got[1].n_turns == 2
    enc = tokens.encoding(tokens.VOCABULARY)
    for conv, r in got.items():
        assert len(r.tokens) == len(r.loss_mask) and r.tokens[0] == chat.BEGIN
        turns, at, mask = [], 1, [0]
        while at < len(r.tokens):
            head, end = r.tokens.index(chat.HEADER, at), r.tokens.index(chat.END, at)
            role = enc.decode(r.tokens[at + 1 : head])
            turns.append((role, chat.unescape(enc.decode(r.tokens[head + 1 : end]))))
            mask += [0] * (head + 1 - at) + [int(role == "assistant")] * (end - head)
            at = end + 1
        assert mask == list(r.loss_mask)
        want = sorted({(t if t is not None else -1, ro or "", tx or "") for c, t, ro, tx in said if c == conv})
        assert turns == [(ro or "user", tx) for _, ro, tx in want]
    assert rows(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))) == []


def test_escaping_is_reversible():
    for text in ("<|", "<\\|", "<\\\\|x", "plain", "<<||>", "a<b|c"):
        assert chat.unescape(chat.escape(text)) == text
        assert "<|" not in chat.escape(text)


# ---- personal data -----------------------------------------------------------------------------


def brute_find(text):
    """Character by character: a list of (character, begin, end) instead of pieces and offsets."""
    cells = [(pii.LIKE.get(ord(c), c), i, i + 1) for i, c in enumerate(text)]
    cells = [c for c in cells if c[0] is not None]
    plain = "".join(c for c, _, _ in cells)
    mapped, spelled = pii.words(plain)
    if mapped:
        out, at = [], 0
        for n, left, right, exact in zip(mapped.norm, mapped.left, mapped.right, mapped.exact, strict=True):
            size = (mapped.norm + [len(mapped.text)])[mapped.norm.index(n) + 1] - n
            for j in range(size):
                a, b = (left + j, left + j + 1) if exact else (left, right)
                out.append((mapped.text[n + j], cells[a][1], cells[b - 1][2]))
        cells = out
    normal = "".join(c for c, _, _ in cells)
    return [(cells[a][1], cells[b - 1][2], kind, normal[a:b]) for a, b, kind in pii.identifiers(normal, spelled)]


CASES = [
    ("mail jane dot doe at example dot com now", [("jane dot doe at example dot com", "email", "jane.doe@example.com")]),
    ("a [at] b.com, x", [("a [at] b.com", "email", "a@b.com")]),
    ("call four one five five five five one two one two ok", [("four one five five five five one two one two", "phone", "4155551212")]),
    ("ｊａｎｅ@ex​ample.com", [("ｊａｎｅ@ex​ample.com", "email", "jane@example.com")]),
    ("tel +1 (706) 555-3138 x 126.57.31.34 y", [("+1 (706) 555-3138", "phone", "+1 (706) 555-3138"), ("126.57.31.34", "ip", "126.57.31.34")]),
    ("4041894974608795 Of onshin", [("4041894974608795", "card", "4041894974608795")]),
    ('token = "9dd3c80004c73dc9e548fee51b23b527780d4f20" tihe', [("9dd3c80004c73dc9e548fee51b23b527780d4f20", "secret", "9dd3c80004c73dc9e548fee51b23b527780d4f20")]),
    ("x 1234567890123456 y 5755695738806563", []),
    ("DE89 3704 0044 0532 0130 00 AND SO ON", [("DE89 3704 0044 0532 0130 00", "iban", "DE89 3704 0044 0532 0130 00")]),
    ("XY11 ABCD EFGH IJKL MNOP", []),
    ("x" * 5000 + "@example.com", [("x" * 5000 + "@example.com", "email", "x" * 5000 + "@example.com")]),
    ("see .@b.com and a.@b.com", []),
    ("look at example.com, be at the dot matrix, one or two", []),
    ("", []),
]


@pytest.mark.parametrize("text,want", CASES)
def test_identifiers(text, want):
    assert [(text[a:b], kind, value) for a, b, kind, value in pii.find(text)] == want
    padded = "ñ‐ " + text + " ​" + text
    assert pii.find(padded) == brute_find(padded)


def test_many_identifiers_take_linear_time():
    text = " ".join(f"u{i}@mail{i}.example.com, jane dot d{i} at example dot com;" for i in range(20_000))
    began = time.process_time()
    assert len(pii.find(text)) == 40_000
    assert time.process_time() - began < 20


def test_detect_and_redact(spark):
    df = awkward(spark).unionByName(frame(spark, [(900, "x me@mail.example.com y 🙂 me@mail.example.com", "en", "s", 0)]).withColumns({k: F.lit(v) for k, v in CLASHES.items()}))
    assert [(r.kind, r.begin, r.end) for r in pii.detect(df).orderBy("begin").collect()] == [("email", 2, 21), ("email", 26, 45)]
    clean = pii.redact(df)
    assert clean.schema == df.schema and clean.count() == df.count()
    assert clean.where("doc_id = 900").first().text == "x [EMAIL] y 🙂 [EMAIL]"
    assert clean.where("doc_id = 100").first().text is None


# ---- language identification -------------------------------------------------------------------


def brute_bits(texts, text, order, least):
    """Code lengths of a text by recursion over dictionaries of counts."""
    counts = {lang: defaultdict(Counter) for lang in texts}
    for lang, own in texts.items():
        for t in own:
            b = [None] * order + list(t.encode())
            for i in range(order, len(b)):
                for d in range(order + 1):
                    counts[lang][tuple(b[i - d : i][::-1])][b[i]] += 1
    used = {()}
    for d in range(1, order + 1):
        for lang in texts:
            for c, n in counts[lang].items():
                if len(c) == d and c[:-1] in used and (d == 1 or sum(n.values()) >= least):
                    used.add(c)

    def bits(lang, context, byte):
        n = counts[lang].get(context, Counter())
        total, distinct = sum(n.values()), len(n)
        below = 8.0 if not context else None
        if total and n[byte]:
            return math.log2((total + distinct) / n[byte])
        below = below if below is not None else bits(lang, context[:-1], byte)
        return below + (math.log2((total + distinct) / distinct) if total else 0)

    out = []
    b = [None] * order + list(text.encode())
    for lang in sorted(texts):
        sum_ = 0.0
        for i in range(order, len(b)):
            context = max((tuple(b[i - d : i][::-1]) for d in range(order + 1) if all(tuple(b[i - e : i][::-1]) in used for e in range(d + 1))), key=len)
            sum_ += bits(lang, context, b[i])
        out.append(sum_)
    return out


def test_code_lengths_against_recursion():
    texts = {"a": ["the cat sat on the mat. " * 6, "that hat"], "b": ["le chat est là, le rat est là. " * 5, "ça"]}
    model = langid.train(texts, least=4)
    probe = ["the rat", "", "là ça 漢", "est", "ZZZ the cat"]
    got, size = langid.code_lengths(pa.array(probe), model)
    for i, p in enumerate(probe):
        assert got[i] == pytest.approx(brute_bits(texts, p, langid.ORDER, 4), rel=1e-5)
        assert size[i] == len(p.encode())


def test_language_on_held_out_and_awkward_rows(spark):
    en, de = vocabulary(1, 50), ["über" + w for w in vocabulary(2, 50)]
    rng = random.Random(0)
    docs = [(i, " ".join(rng.choice(en if i % 2 else de) for _ in range(30)), "en" if i % 2 else "de", "s", 0) for i in range(80)]
    model = langid.fit(frame(spark, docs[:60]))
    got = {r.doc_id: r for r in langid.identify(frame(spark, docs[60:]), model).collect()}
    assert all(got[d[0]].language == d[2] and got[d[0]].keep for d in docs[60:])
    odd = frame(spark, [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "12345 !!! " * 40, "en", "s", 0), (4, "\x01\x02漢字仮名" * 100, None, "s", 0), (None, docs[61][1], "en", "s", 0)]).withColumn("keep", F.lit(9))
    assert sorted((r.doc_id or -1, r.keep) for r in langid.identify(odd, model).collect()) == [(-1, True), (1, False), (2, False), (3, False), (4, False)]
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and kept.count() == 1
    assert langid.fit(frame(spark, [])) is None
    assert langid.keep_identified(frame(spark, docs[:5]), None).count() == 5


# ---- fingerprints ------------------------------------------------------------------------------


def test_sketches_merge_and_estimate_containment(spark):
    rng, words = random.Random(8), vocabulary(8, 3000)
    long = [rng.choice(words) for _ in range(6000)]
    docs = [(1, " ".join(long), "en", "s", 0), (2, " ".join(long[1000:2000]), "en", "s", 0), (3, " ".join(rng.choice(words) for _ in range(1000)), "en", "s", 0), (4, "", "en", "s", 0), (5, "Two words", "en", "s", 0), (None, "x", "en", "s", 0)]
    out = fingerprint.fingerprints(frame(spark, docs), n=4, scale=8)
    got = {r.doc_id: r for r in out.collect()}
    for i, text, *_ in docs[:5]:
        w = words_of(text)
        sets = {tuple(w[p : p + 4]) for p in range(max(len(w) - 3, 1))} if w else set()
        assert got[i].n_shingles == len(sets) and got[i].n_kept == len(got[i].sketch) and list(got[i].sketch) == sorted(got[i].sketch)
    share = lambda a, b: len(set(got[a].sketch) & set(got[b].sketch)) / len(got[a].sketch)
    assert share(2, 1) == 1.0 and share(3, 1) < 0.05
    assert abs(got[1].n_kept * 8 / got[1].n_shingles - 1) < 0.15
    both = " ".join(long[:1000])
    parts = fingerprint.fingerprints(frame(spark, [(1, both, "en", "s", 0), (2, " ".join(long[500:2000]), "en", "s", 0)]), 4, 8)
    merged = fingerprint.merge(parts.withColumn("all", F.lit(1)), ["all"]).first().sketch
    assert list(merged) == sorted(set().union(*(set(r.sketch) for r in parts.collect())))
    pairs = fingerprint.contained_in(out.where("doc_id = 2"), out, 0.9).orderBy("doc_id").collect()
    assert [(r.item_id, r.doc_id) for r in pairs] == [(2, 1), (2, 2)]


def test_short_passages_have_sketches(spark, tmp_path):
    rng, words = random.Random(12), vocabulary(12, 2000)
    passages = [(i, " ".join(rng.choice(words) for _ in range(24 + i % 30))) for i in range(100)]
    filler = lambda: " ".join(rng.choice(words) for _ in range(400))
    docs = [(i, f"{filler()} {text} {filler()}", "en", "s", 0) for i, text in passages]
    spark.createDataFrame([*passages, (100, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    assert fingerprint.op6_fingerprints(spark, str(tmp_path)).agg(F.min("n_kept")).first()[0] > 0
    got = fingerprint.op6_containment(spark, str(tmp_path)).collect()
    assert {r.item_id for r in got} == set(range(101)) and all(r.doc_id is None for r in got if r.n_kept == 0)
    assert sum(r.n_kept == 0 for r in got) <= 3
    assert all(r.doc_id == r.item_id and r.containment == 1.0 for r in got if r.n_kept > 0)


# ---- n-gram Jaccard join -----------------------------------------------------------------------


def brute_pairs(docs, n, threshold):
    sets = {}
    for i, text, *_ in docs:
        w = words_of(text)
        if i is not None and w:
            sets[i] = {tuple(w[p : p + n]) for p in range(max(len(w) - n + 1, 1))}
    out = []
    for a in sets:
        for b in sets:
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold:
                out.append((a, b, round(j, 9)))
    return sorted(out)


@pytest.mark.parametrize("local,group,hot", [(4, 512, 1 << 16), (4096, 512, 1 << 16), (4096, 16, 1 << 16), (8, 12, 1)])
def test_jaccard_pairs(spark, local, group, hot):
    docs = corpus(11, 140) + [(600 + i, " ".join(vocabulary(6, 80)[: 60 + i % 12]), "en", "s", 0) for i in range(30)] + [(700, "Ab", "en", "s", 0), (701, "aB", "en", "s", 0), (702, "", "en", "s", 0), (703, None, "en", "s", 0), (704, " ", "en", "s", 0)]
    want = brute_pairs(docs, 3, 0.5)
    got = sorted((r.doc_a, r.doc_b, round(r.jaccard, 9)) for r in ngram_join.jaccard_pairs(frame(spark, docs), local=local, group=group, hot=hot).collect())
    assert set(got) <= set(want) and len(got) == len(set(got))
    assert len(got) >= 0.95 * len(want) and len(want) > 100


def brute_classes(docs, n=3, threshold=0.5):
    links = defaultdict(set)
    for a, b, _ in brute_pairs(docs, n, threshold):
        links[a].add(b)
        links[b].add(a)
    out = {}
    for i in {i for i, *_ in docs if i is not None}:
        seen, stack = {i}, [i]
        while stack:
            for o in links[stack.pop()] - seen:
                seen.add(o)
                stack.append(o)
        out[i] = (min(seen), len(links[i]))
    return out


@pytest.mark.parametrize("group,hot", [(512, 1 << 16), (16, 1)])
def test_classes_and_links(spark, group, hot):
    docs = corpus(12, 60) + [(600 + i, " ".join(vocabulary(6, 80)[: 60 + i % 12]), "en", "s", 0) for i in range(40)] + [(800, None, "en", "s", 0), (801, "", "en", "s", 0), (None, "x", "en", "s", 0)]
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.classes(frame(spark, docs).withColumns({"part": F.lit(0), "own": F.lit(1)}), group=group, hot=hot).collect()}
    assert got == brute_classes(docs)
    assert rows(ngram_join.classes(frame(spark, []))) == []


def test_one_of_each_group_stays(spark):
    docs = [*corpus(12, 60), (None, "x", "en", "s", 0)]
    got = ngram_join.keep_one_of_each_group(frame(spark, docs).withColumn("node", F.lit(0)))
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == sorted({-1, *(c for c, _ in brute_classes(docs).values())})


def near_copies(n, seed=1, size=120, noise=0.05):
    """Copies of one text of which each word is replaced with the probability ``noise``."""
    rng, words = np.random.default_rng(seed), np.array(vocabulary(seed, 20_000))
    base = rng.integers(0, len(words), size)
    return [(i, " ".join(words[np.where(rng.random(size) < noise, rng.integers(0, len(words), size), base)]), "en", "s", 0) for i in range(n)]


def test_many_near_copies_pass_on_few_rows(spark):
    docs = near_copies(3000)
    sets = spark.createDataFrame(pa.Table.from_batches([b for x in pa.Table.from_pylist([{"doc_id": i, "text": t} for i, t, *_ in docs]).to_batches() for b in ngram_join._signatures(3)(iter([x]))]).select(["doc_id", "sign"]).rename_columns(["rid", "sign"]).to_pandas())
    pairs, members = ngram_join.candidates(sets, 0.5, 0.99)
    assert members.select("rid").distinct().count() > 2900 and pairs.count() + members.count() < 300 * len(docs)
    docs = docs[:800]
    want = brute_classes(docs)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.classes(frame(spark, docs)).collect()}
    assert sum(got[i] != x for i, x in want.items()) <= 8 and all(got[i][1] <= x[1] for i, x in want.items())


def test_groups_come_in_pieces():
    rng = random.Random(2)
    for most in (5, 40):
        keys = sorted(rng.choice([1, 1, 1, 2, 3, *range(4, 30)]) for _ in range(300))
        batches, at = [], 0
        while at < len(keys):
            n = rng.randint(1, 20)
            batches.append(pa.RecordBatch.from_pydict({"k": keys[at : at + n]}))
            at += n
        seen, whole = [], []
        for table, all_of_it in kernel.pieces(iter(batches), "k", most):
            own = table.column("k").to_pylist()
            seen += own
            assert all_of_it or len(set(own)) == 1
            whole += sorted(set(own)) if all_of_it else []
        assert seen == keys and len(whole) == len(set(whole))
        assert all(keys.count(x) == seen.count(x) for x in whole)


def test_recall_counts_all_levels():
    assert ngram_join.runs_for(0.5, 0.99) >= 8 and ngram_join.runs_for(0.5, 0.99, 12) > ngram_join.runs_for(0.5, 0.99, 4)
    least, lost = ngram_join.least_agreement(0.5, 0.0025)
    assert 0 < least < 16 and lost <= 0.0025


# ---- packing and mixing ------------------------------------------------------------------------


def brute_pack(queues, weights, capacity):
    """Round by round: credit in shares, whole tokens served, what is left of the credit carried as a deficit."""
    left = {s: list(q) for s, q in sorted(queues.items()) if q}
    owed = {s: Fraction(len(q)) for s, q in left.items()}  # credit that a source can still use
    deficit = dict.fromkeys(left, Fraction(0))
    stream = []
    while any(left.values()):
        rest, credit = Fraction(capacity), dict.fromkeys(left, Fraction(0))
        while rest and (alive := [s for s in left if owed[s] > credit[s]]):
            level = min([(owed[s] - credit[s]) / weights[s] for s in alive] + [rest / sum(weights[s] for s in alive)])
            for s in alive:
                credit[s] += level * weights[s]
            rest -= level * sum(weights[s] for s in alive)
        for s in left:
            deficit[s] += credit[s]
            owed[s] -= credit[s]
            n = math.floor(deficit[s])
            deficit[s] -= n
            assert 0 <= deficit[s] < 1
            stream += left[s][:n]
            left[s] = left[s][n:]
    return [stream[i : i + capacity] for i in range(0, len(stream), capacity)]


def packed(spark, docs, weights, capacity):
    items, _ = packing.prefix.queue(frame(spark, docs), packing.SEED, None)
    queues = defaultdict(list)
    for r in sorted(items.collect(), key=lambda r: (r.place, r.doc_id)):
        queues[r.source] += [(r.doc_id, j) for j in range(r.tokens)]
    want = brute_pack(queues, defaultdict(lambda: 1, weights), capacity)
    got = [[None] * len(w) for w in want]
    for r in packing.pack(frame(spark, docs), weights, capacity=capacity, vocabulary=None).collect():
        for j in range(r.n_tokens):
            assert got[r.window][r.position + j] is None
            got[r.window][r.position + j] = (r.doc_id, r.doc_start + j)
    return got, want


@pytest.mark.parametrize("capacity", [5, 23, 64])
def test_packing_against_rounds(spark, capacity):
    docs = corpus(21, 40) + [(900, None, None, "src0", 0), (901, "alone " * 37, None, None, 0)]
    got, want = packed(spark, docs, {"src0": 4, "src1": 3, "src2": 2}, capacity)
    assert got == want and all(len(w) == capacity for w in want[:-1])


def test_packing_many_sources(spark):
    docs = [(i, f"w{i} " * (i % 5 + 1), "en", f"site{i % 150}", 0) for i in range(300)]
    got, want = packed(spark, docs, {"site7": 3}, 16)
    assert got == want
    docs = [(i, "a b c", "en", f"site{i}", 0) for i in range(3000)]
    assert packing.pack(frame(spark, docs), vocabulary=None).agg(F.sum("n_tokens"), F.max("window")).first()[:] == (9000, 9000 // packing.CAPACITY)


def test_packing_keeps_proportions(spark):
    docs = [(i, "x " * (40 + i % 30), "en", f"src{i % 4}", 0) for i in range(1200)]
    got = packing.pack(frame(spark, docs), vocabulary=None).groupBy("window").pivot("source").sum("n_tokens").orderBy("window").collect()
    total = {"src0": 0, "src1": 0, "src2": 0, "src3": 0}
    for r in got[:12]:
        for s, w in zip(total, (4, 3, 2, 1), strict=True):
            assert abs(r[s] - packing.CAPACITY * w / 10) <= 4


def test_tokens_of_the_vocabulary(spark):
    docs = [*corpus(24, 20), (500, " " * 9000 + "x" + "\n" * 6000, "en", "src0", 0), (501, None, "en", "src0", 0)]
    items, _ = packing.prefix.queue(frame(spark, docs), packing.SEED, tokens.VOCABULARY)
    enc = tokens.encoding(tokens.VOCABULARY)
    got = {r.doc_id: r.tokens for r in items.collect()}
    assert got == {i: len(tokens.encode(t or "")) for i, t, *_ in docs}
    assert all(got[i] == len(enc.encode_ordinary(t)) for i, t, *_ in docs[:-2])
    assert packing.pack(frame(spark, docs)).agg(F.sum("n_tokens")).first()[0] == sum(got.values())


def test_long_stretches_have_the_tokens_of_the_whole():
    rng, enc = random.Random(5), tokens.encoding(tokens.VOCABULARY)
    for text in ("".join(rng.choice("abcdefghij") for _ in range(100_000)), "!?" * 30_000, "1" * 50_000, "a b" * 30_000, "x" + " " * 7000 + "y", "x" + "\n" * 5000, " " * 6000 + "\u2003z", "ab" * 100 + "\t " * 2500 + "c"):
        assert tokens.encode(text) == enc.encode_ordinary(text)
    far = "x" + " " * 300_000 + "y"
    assert enc.decode(tokens.encode(far)) == far


def test_mixing_against_a_loop(spark):
    docs = corpus(22, 50) + [(900, None, None, "src0", 0), (901, "a b", None, None, 0), (901, "c", None, "zz", 0)]
    weights = {"src0": 5, "src1": 1}
    for vocabulary in (None, tokens.VOCABULARY):
        items, _ = mixing.prefix.queue(frame(spark, docs), mixing.SEED, vocabulary)
        items = sorted(items.collect(), key=lambda r: (r.place, r.doc_id))
        had, timed = Counter(), []
        for r in items:
            had[r.source] += r.tokens
            timed.append((had[r.source] / weights.get(r.source, 1), r.place, r.doc_id, r.source, r.tokens))
        total, want = 0, []
        for time, _, i, source, n in sorted(timed):
            total += n
            if total <= 700:
                want.append((i, source, n, time, total))
        assert rows(mixing.mix(frame(spark, docs), weights, budget=700, vocabulary=vocabulary)) == want
    assert sum(r.tokens for r in items if r.doc_id == 901) == len(tokens.encode("a b")) + len(tokens.encode("c"))


def test_mixing_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    docs = [r for r in corpus(23, 80)]
    con = duckdb.connect()
    con.register("documents", frame(spark, docs).toPandas())
    assert sorted(rows(mixing.mix(frame(spark, docs), vocabulary=None))) == sorted(con.execute(mixing.WORDS_SQL).fetchall())


def test_ranges_of_a_mix_are_even(spark):
    """Whatever the weights: a source of a thousand times the weight is not all in one range."""
    shares = mixing.prefix.Shares(np.array([0.0, 10.0, 4000.0]), np.array([0.0, 10_010.0, 14_000.0]), np.array([1001.0, 1.0, 0.0]))
    times = np.sort(np.concatenate([np.arange(1, 10_001) / 1000, np.arange(1, 4001)]))
    out = shares.served_at(times)
    assert (np.diff(out) >= 0).all() and np.bincount((out / 14_000 * 14).astype(int), minlength=14)[:14].max() < 1100
    assert np.allclose(shares.time_at(shares.served_at(times[:-1])), times[:-1])


def test_running_totals_over_levels(spark):
    rng = random.Random(3)
    data = [(f"k{i % 3}", rng.randrange(1000), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(data, "key string, at int, id long, n long")
    for levels in ([100, 10, 1], [7], [1000, 50]):
        got = {r.id: r.total for r in mixing.prefix.running_total(df, ["key"], [F.floor(F.col("at") / x) for x in levels], ["at", "id"], "n", "total").collect()}
        assert got == {i: sum(m for c, b, j, m in data if c == key and (b, j) <= (at, i)) for key, at, i, _ in data}


# ---- top-k -------------------------------------------------------------------------------------


def test_topk_against_all_scores(spark):
    docs = corpus(31, 120) + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    items = [(1, docs[5][1]), (2, "nothing known here"), (3, None), (4, ""), (5, docs[40][1] + " " + docs[41][1]), (5, docs[7][1])]
    tf = {i: Counter(words_of(t)) for i, t, *_ in docs}
    n, total = len(docs), sum(sum(c.values()) for c in tf.values())
    df = Counter(w for c in tf.values() for w in c)
    want = []
    per = defaultdict(list)
    for item, text in items:
        for i, c in tf.items():
            score = sum(int(math.floor(1000 * math.log(1 + n / df[w]))) * c[w] * 2200 // (c[w] * 1000 + 300 + 900_000 * sum(c.values()) // (1000 * total // n)) for w in set(words_of(text)) if w in c)
            if score > 0:
                per[item, text].append((-score, i))
    best = defaultdict(list)
    for (item, _), found in per.items():
        best[item] += sorted(found)[:7]
    for item, found in best.items():
        want += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:7])]
    got = rows(topk.top_documents(spark.createDataFrame(items, "item_id long, text string"), frame(spark, docs), 7))
    assert sorted(got) == sorted(want)


def test_impacts_do_not_overflow():
    mean = topk.mean_length(5 * 10**10, 10**14)
    got = topk.impact(np.array([20_000]), np.array([10**6]), np.array([10**9]), mean)
    assert got[0] == 20_000 * 10**6 * 2200 // (10**9 + 300 + 900_000 * 10**9 // mean)


def test_search_stops_early():
    rng = np.random.default_rng(3)
    n, lists = 4000, 6
    docs = np.concatenate([rng.permutation(n) for _ in range(lists)])
    value = np.concatenate([np.sort((rng.pareto(1.2, n) * 100).astype(np.int64) + 1)[::-1] for _ in range(lists)])
    stats: dict = {}
    found, score = topk.search_lists(docs, value, np.arange(lists) * n, (np.arange(lists) + 1) * n, n, 5, stats)
    full = np.bincount(docs, value, minlength=n).astype(np.int64)
    want = np.lexsort((np.arange(n), -full))[:5]
    assert list(found) == list(want) and list(score) == list(full[want])
    assert stats["read"] < stats["all"] / 2


# ---- all on awkward and empty tables -----------------------------------------------------------


def everything(spark, df):
    labels = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    items = df.select(F.col("doc_id").alias("item_id"), "text", F.lit(1).alias("doc_id"))
    return {
        "substring": substring.repeated_passages(df), "toxicity": toxicity.classify(df, toxicity.fit(df, labels, epochs=1)), "pii": pii.detect(df), "language": langid.identify(df, langid.fit(df)), "fingerprint": fingerprint.fingerprints(df),
        "join": ngram_join.jaccard_pairs(df), "packing": packing.pack(df), "topk": topk.top_documents(items, df), "mixing": mixing.mix(df),
    }


def test_awkward_tables(spark):
    got = {name: rows(df) for name, df in everything(spark, awkward(spark)).items()}
    assert {r[0] for r in got["substring"]} >= {103, 104}
    assert len(got["language"]) == awkward(spark).count() and len(got["fingerprint"]) == awkward(spark).where("doc_id is not null").count()
    assert (103, 104, 1.0) in got["join"] and not any(a == b for a, b, _ in got["join"])
    plain = {name: rows(df) for name, df in everything(spark, awkward(spark, extra=False)).items()}
    for name in ("substring", "pii", "fingerprint", "join", "packing", "topk", "mixing"):
        assert sorted(map(repr, got[name])) == sorted(map(repr, plain[name])), name


def test_empty_tables(spark):
    for name, df in everything(spark, spark.createDataFrame([], SCHEMA)).items():
        assert rows(df) == [], name


def test_pipeline_stages(spark, tmp_path):
    docs = awkward(spark).union(frame(spark, [(i + 1000, t, lang, s, n) for i, t, lang, s, n in corpus(41, 60)]).withColumns({k: F.lit(v) for k, v in CLASHES.items()}))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
        assert docs.count() > 0, name
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0
