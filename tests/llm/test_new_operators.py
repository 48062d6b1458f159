"""Fill-in-the-middle, source divergence and quality rules against plain Python, over edge rows and drawn texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import divergence, fim, rules
from maskwright.llm.common import text_bytes
from test_edges import SCHEMA, edge_rows

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    more = [(300, "é" * 7 + " 日本 \U0001f600\U0001f600 ende  ", "de", "b"), (301, "mit <S> marke", "de", "b"), (302, "a\n\na\n a\na", "en", "b"), (303, "x " * 40, "en", "c")]
    return spark.createDataFrame([*edge_rows(), *[(*r, len(r[1]), 7, "x", 0, "r", "k") for r in more]], SCHEMA).cache()


def drawn_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "é", "日", "\U0001f600", " ", "\n", "\t", "#", "<", "wort", "W"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(n)]


def plain_fim(key, text, unit):
    units = list(text) if unit == "char" else UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("unit", ["word", "char"])
def test_fill_in_middle(spark, docs, unit):
    drawn = spark.createDataFrame(list(enumerate(drawn_texts(400, 5))), "doc_id bigint, text string")
    forms = Counter()
    for table in (docs, drawn):
        rows = fim.restore(fim.transform(table, unit=unit)).collect()
        assert len(rows) == table.count()
        for r in rows:
            assert (r["__units"], r["__form"], r["__prefix_chars"], r["__middle_chars"], r["__output"]) == plain_fim(r.doc_id, r.text or "", unit)
            assert r["__restored"] == (r.text or "")
            forms[r["__form"]] += 1
    assert min(forms[f] for f in ("plain", "spm", "psm")) > 20
    assert fim.transform(docs.limit(0)).collect() == []
    assert set(docs.columns) <= set(fim.transform(docs).columns)


def test_sparse_index():
    text = "aé日\U0001f600b" * 50 + "plain"
    data, bounds = text_bytes(pa.array([text]))
    index = fim.Exceptions.of(data)
    offsets = np.cumsum([0, *[len(c.encode()) for c in text]])
    assert (index.points(offsets) == np.arange(len(text) + 1)).all()
    assert (index.offsets(np.arange(len(text) + 1)) == offsets).all()
    assert len(index.at) == 150  # only characters of several bytes


def plain_audit(rows, least):
    groups, in_docs, counts = set(), Counter(), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        in_docs.update({(lang, t) for t in terms})
        counts[lang, source].update(terms)
    out = set()
    for lang, source in groups:
        kept = sorted(t for (x, t), n in in_docs.items() if x == lang and n >= least)
        sources = sorted(s for x, s in groups if x == lang)

        def share(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        own, whole = share(counts[lang, source]), share(sum((counts[lang, s] for s in sources), Counter()))
        pairs = [(s, sum(abs(own[t] - share(counts[lang, s])[t]) for t in kept)) for s in sources if s != source]
        terms = [(t, own[t] - whole[t]) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", terms, 50)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("cells", [divergence.SHARD_CELLS, 16])
def test_source_divergence(spark, docs, cells, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_CELLS", cells)
    rows = [(r.text, r.lang, r.source) for r in docs.collect()]
    rng = random.Random(9)
    words = [f"{a}{b}{c}" for a in "abÉé" for b in "xyz日" for c in "pqR"]
    rows += [(" ".join(rng.choice(words) for _ in range(12)), rng.choice(["en", None]), rng.choice(["a", "b", None, "ü"])) for _ in range(150)]
    table = spark.createDataFrame(rows, "text string, lang string, source string").repartition(7)
    got = [tuple(r) for r in divergence.audit(table, least=4).collect()]
    assert len(got) == len(set(got)) and set(got) == plain_audit(rows, 4)
    assert {p for _, _, p, *_ in got} == {"pair", "term"}
    assert divergence.audit(table.limit(0)).collect() == []
    assert {r.value for r in divergence.audit(docs, least=10_000).collect()} == {0}  # nothing kept


def test_shares_leave_no_bits():
    counts, totals = np.array([0, 3, 10**15]), np.array([4 * 10**15])
    want = [1 + 10**9 * (int(c) + 5) // (4 * 10**15 + 5 * 7) for c in counts]
    assert divergence.shares(counts, totals, 7).tolist() == want


def plain_base(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def plain_score(text, log):
    total = [int(log[((ord(a) * 1000003 + ord(b)) * 1000003 + ord(c)) % 2147483647 % 65536]) for a, b, c in zip(text, text[1:], text[2:], strict=False)]
    return sum(total) / max(len(total), 1)


def test_quality_rules(spark, docs, monkeypatch):
    monkeypatch.setattr(rules, "POINTS_AT_ONCE", 1000)  # several stretches a text
    rng = random.Random(8)
    texts = drawn_texts(100, 6) + ["\n".join(rng.choice(["a b c d e f", "x", "", " ", "a b c d e g h"]) for _ in range(12)) for _ in range(100)]
    drawn = spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id bigint, text string")
    ids = drawn.where("doc_id % 2 = 0").select("doc_id")
    model = rules.fit(drawn, ids)
    trusted, raw = Counter(), Counter()
    parts = {r.doc_id: r.d for r in ids.select("doc_id", rules.unit_draw(rules.SEED, "doc_id").alias("d")).collect()}
    for i, t in enumerate(texts, 1000):
        grams = [((ord(a) * 1000003 + ord(b)) * 1000003 + ord(c)) % 2147483647 % 65536 for a, b, c in zip(t, t[1:], t[2:], strict=False)]
        raw.update(grams)
        if parts.get(i, 0) >= rules.SETTING:
            trusted.update(grams)
    assert model.log.tolist() == rules.log_ratios(*[np.array([c[b] for b in range(rules.BUCKETS)]) for c in (trusted, raw)]).tolist()
    setting = [plain_score(texts[i - 1000], model.log) for i, d in parts.items() if d < rules.SETTING and len(texts[i - 1000]) > 2]
    assert abs(model.threshold - (np.quantile(setting, rules.QUANTILE) - rules.MARGIN)) < 1e-3
    for table in (docs, drawn):
        rows = rules.judge(table.select("*", F.col("text").alias("copy")), model).collect()
        assert len(rows) == table.count()
        for r in rows:
            text = r.copy or ""
            base = tuple(r[f"__{n}"] for n in rules.RESULT[:5])
            assert base == plain_base(text)
            failed = base[0] < 10 or 100 * base[4] > 20 * base[0]
            assert r["__base_failed"] == failed
            assert r["__score"] == plain_score(text, model.log)
            assert r["__kept"] == (not failed and r["__score"] >= model.threshold)
    assert rules.judge(docs.limit(0), model).collect() == []


def test_quality_rules_without_trusted_texts(spark, docs):
    for trusted in (docs.select("doc_id").limit(0), docs.select((F.col("doc_id") + 10_000).alias("doc_id"))):
        model = rules.fit(docs, trusted)
        rows = rules.judge(docs, model).collect()
        assert all(r["__kept"] != r["__base_failed"] for r in rows)
    assert rules.fit(docs.limit(0), docs.select("doc_id")).threshold == -float("inf")
