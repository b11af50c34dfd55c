"""The corpus pipeline: its stages in turn on planted cases, and whole."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxelmill.llm import quality, secrets
from voxelmill.llm._shared import default_tokenizer

SF = "/root/testdata/sf0.001"


def test_whole_pipeline(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and {r.doc_id for r in rows} <= {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    held = defaultdict(int)
    for r in rows:
        held[r.sequence_id] += r.length
    assert max(held.values()) <= 4096


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(3000)]
    base = [" ".join(rng.choice(words, 400)) for _ in range(30)]
    near = [b.replace(b.split()[200], "other", 1) for b in base[:10]]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate([*base, *near, *base[10:20], "", "", None])]
    rows += [rows[3], (None, base[4], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = cp.near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(30), 50]
    assert cp.near_duplicates(spark, docs.limit(0), SF).count() == 0


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = {n: F.lit(1) for n in ("score", "_row", "_kept", "_digest", "_spans", "component", "label", "rate", "topic", "tokens", "f0", "row", "owner", "_metadata", "key")}
    extra["of_a_map"] = F.create_map(F.lit("a"), F.lit(1))
    for table in (docs, docs.withColumns(extra)):
        for name, stage in cp.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns, name
            assert out.select(F.count("*")).first()[0] > 0


def test_nothing_goes_through_all_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def slow_near_duplicates(texts):
    """Places of the texts that stay: the first of each group of exact similarity 0.8."""
    sets, label = [shingles(t) for t in texts], {}
    for i in range(len(texts)):
        if i not in label:
            queue, label[i] = [i], i
            while queue:
                a = queue.pop()
                for b in range(len(texts)):
                    if b not in label and alike(sets[a], sets[b]):
                        label[b] = i
                        queue.append(b)
    return sorted(set(label.values()))


def graded_texts(seed=12, bases=60):
    """Pairs on both sides of 0.8: tails of 205 words replaced, so that 5 * shared and 4 * all are close."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for i in range(bases):
        n = int(rng.integers(8, 400))
        base = list(rng.choice(words, n))
        # a new tail of x words leaves n - 4 - x of n - 4 shingles: similarity (m - x) / (m + x)
        exact = (n - 4) / 9
        for x in {int(exact) + d for d in (-1, 0, 1, 2)}:
            if 0 <= x < n:
                texts.append(" ".join([*base[: n - x], *(f"t{i}_{x}_{k}" for k in range(x))]))
        texts.append(" ".join(base))
    return texts


def test_near_duplicates_are_those_of_exact_similarity(spark):
    texts = [*graded_texts(), "", "one two", "One  TWO", None, "one two three"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r.doc_id for r in cp.near_duplicates(spark, docs, SF).collect())
    assert kept == slow_near_duplicates(texts)


def test_split_groups_lose_no_link(spark):
    from voxelmill.llm import jaccard

    texts = graded_texts(bases=12)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "row long, text string")
    rows = jaccard.similar_groups(docs, row="row", block_shingles=100, bucket_limit=4, hot_rows=2).collect()
    least = defaultdict(list)
    for r in rows:
        least[r.component].append(r.row)
    assert sorted(map(min, least.values())) == slow_near_duplicates(texts)


def slow_features(text):
    """The twenty features, one after another."""
    raw, words = text.encode(), text.split()
    n, w = max(len(raw), 1), max(len(words), 1)
    lines = [x for x in text.split("\n") if x.strip()]
    some = lambda chars: sum(chr(c) in chars for c in raw)
    upper, lower, digits = some("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), some("abcdefghijklmnopqrstuvwxyz"), some("0123456789")
    plain, printable = some("!\"'(),-.:;?"), sum(33 <= c < 127 for c in raw)
    per = len(lines) or 1
    return [
        math.log1p(len(text)), len(text) / w, (upper + lower) / n, upper / max(upper + lower, 1), digits / n, plain / n, (printable - upper - lower - digits - plain) / n, sum(c > 127 for c in raw) / n, some("\t\n\r ") / n, math.log1p(len(lines)),
        w / per, 1 - len(set(lines)) / per, len(set(words)) / w, max(Counter(words).values(), default=0) / w, sum(a == b for a, b in zip(words, words[1:], strict=False)) / w, sum(not x[-1].isalnum() and x[-1] not in ".," for x in words) / w,
        sum(x.isupper() for x in words) / w, sum(len(x) < 4 for x in words) / w, some("|") / w, some(".") / per,
    ]


def slow_score(model, text):
    at = [sum(edge <= v for edge in edges) for v, edges in zip(slow_features(text), model.edges, strict=True)]
    logit = model.intercept + sum(float(t[b]) for t, b in zip(model.tables, at, strict=True))
    logit += sum(float(t[at[i]][at[j]]) for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    return 1 / (1 + math.exp(-logit))


def test_scores_equal_brute_force(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = quality.score_documents(docs, model, keep=("doc_id", "text")).collect()
    assert len(rows) == docs.count() and model.pairs
    assert all(abs(r.score - slow_score(model, r.text or "")) < 1e-9 for r in rows)


def slow_redaction(docs):
    """Texts with the values masked that fewer than three sources hold."""
    opaque = lambda v: any(map(str.isdigit, v)) and any(map(str.islower, v)) and any(map(str.isupper, v)) and sum(-c / len(v) * math.log2(c / len(v)) for c in Counter(v).values()) >= 3.5
    spans, owners = [], defaultdict(set)
    for d in docs:
        text, found = d.text or "", []
        for pattern, group, least in ((secrets.ASSIGN, 2, 6), (secrets.ACCESS, 0, 20), (re.compile("[0-9a-f]+"), 0, 24)):
            found += [(m.span(), m.span(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
        base = [s for s, _ in found]
        found += [(m.span(), m.span()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text) if opaque(m.group()) and not any(s < m.end() and m.start() < e for s, e in base)]
        spans.append([v for _, v in found])
        for s, e in spans[-1]:
            owners[text[s:e]].add(d.source)
    out = []
    for d, values in zip(docs, spans, strict=True):
        text, masked, at = d.text or "", "", 0
        for s, e in sorted((s, e) for s, e in values if len(owners[text[s:e]]) < 3):
            if s >= at:
                masked += text[at:s] + "[SECRET]"
            at = max(at, e)
        out.append(masked + text[at:])
    return out


def slow_mix(docs, texts):
    """Places of the documents that stay, as often as they do."""
    words = [len(re.findall(r"[^ \t\n\x0b\f\r]+", t)) for t in texts]
    topic = ["table" if " | " in t else "short" if w < 50 else "listing" if w < 8 * (t.count("\n") + 1) else "prose" for t, w in zip(texts, words, strict=True)]
    keys = [(d.source or "(none)", d.lang or "(none)", t) for d, t in zip(docs, topic, strict=True)]
    mass = Counter()
    for key, w in zip(keys, words, strict=True):
        mass[key] += w
    total = sum(mass.values())
    own = [Counter() for _ in range(3)]
    for key, m in mass.items():
        for margin in range(3):
            own[margin][key[margin]] += m
    aims = [{v: (m / total) ** 0.8 / sum((x / total) ** 0.8 for x in o.values()) for v, m in o.items()} for o in own]
    factor = dict.fromkeys(mass, 1.0)
    for margin in [0, 1, 2] * 8:
        now = Counter()
        for key, m in mass.items():
            now[key[margin]] += m * factor[key] / total
        for key in mass:
            if now[key[margin]] > 0:
                factor[key] *= aims[margin][key[margin]] / now[key[margin]]
    scale = 0.8 * total / sum(m * factor[key] for key, m in mass.items())
    kept = []
    for i, (d, key) in enumerate(zip(docs, keys, strict=True)):
        rate = scale * factor[key] if mass[key] else 1.0
        draw = int(hashlib.md5(f"mix:{d.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        kept += [i] * (int(rate) + (draw < rate - int(rate)))
    return kept


def test_pipeline_equals_brute_force(spark):
    """All five stages in plain Python: the same documents as often, each with all of its ids."""
    read = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    model = quality.train(read("documents"), read("labels"))
    docs = sorted((d for d in read("documents").collect() if slow_score(model, d.text or "") >= 0.7), key=lambda d: d.doc_id)
    docs = [docs[i] for i in slow_near_duplicates([d.text for d in docs])]
    texts = slow_redaction(docs)
    encode = Tokenizer.from_file(default_tokenizer()).encode
    expected = Counter()
    for i in slow_mix(docs, texts):
        ids = [*encode(texts[i], add_special_tokens=False).ids, 2]
        expected[docs[i].doc_id, len(ids)] += len(ids)
    got = Counter()
    for r in cp.run(spark, SF).collect():
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == expected and len(got) > 50


def test_fingerprints_within_four_bits_are_candidates(spark):
    """Pairs that the deletion-variant signatures find, and no band: they are checked exactly too."""
    from voxelmill.llm import jaccard, simhash

    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(-(2**62), 2**62, 40)]
    near = [x ^ sum(1 << int(b) for b in rng.choice(60, i % 7, replace=False)) for i, x in enumerate(base)]
    prints = [*base, *near]
    rows = [(i, 5, p, *(int(x) for x in rng.integers(-(2**62), 2**62, 3)), [int(rng.integers(2**62))]) for i, p in enumerate(prints)]
    empty = [(-1, 0, 0, 0, 0, 0, []), (-2, 5, 1, 0, 0, 0, [7])]
    distinct = spark.createDataFrame([*rows, *empty], "node long, n long, f0 long, f1 long, f2 long, f3 long, bands array<long>")
    got = {frozenset((r.u, r.v)) for r in jaccard.candidates(distinct, bucket_limit=16384).collect()}
    assert got == {frozenset((i, i + 40)) for i in range(40) if i % 7 <= 4}
    assert jaccard.links is simhash.links
