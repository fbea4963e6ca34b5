"""The pipeline stage by stage, the mix, license scans and learned cutoffs, each against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from test_operators import prose, word_shingles

from pixelmill.llm import common, licenses, mixing, quality, suffix

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_mix(rows, weights=(5, 2, 1), share=1.5):
    """Copies taken of each (id, source, size)."""
    sources = sorted({s for _, s, _ in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, t, n in rows if t == s) for s in sources}
    line = []
    for k, source in enumerate(sources):
        own = sorted((int(hashlib.md5(f"7-{'' if i is None else i}".encode()).hexdigest()[:15], 16), i, n) for i, s, n in rows if s == source)
        run = 0
        for h, i, n in own:
            run += n
            line += [((c * total[source] + run) / weights[k % len(weights)], k, h, i, c, n) for c in range(2)]
    copies, used = Counter(), 0
    for _, _, _, i, _, n in sorted(line):
        used += n
        if used > share * sum(total.values()):
            break
        copies[i] += 1
    return copies


def test_mix_is_the_queue(spark):
    rng = random.Random(41)
    sources = ["a"] * 60 + ["b"] * 20 + ["ç", None, "d"]
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 30, 200]))), rng.choice(sources)) for i in range(300)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    expect = brute_mix([(i, s, len(WORD.findall(t))) for i, t, s in rows])
    assert {r.doc_id: r.copies for r in got} == {i: expect[i] for i, *_ in rows}


def test_taken_rows_keep_their_columns(spark):
    names = ["doc_id", "text", "source", "_doc_id", "_source", "_size", "_copies", "size", "row"]
    docs = spark.createDataFrame([(i, "a b c", "s", *"123456") for i in range(9)], "doc_id long, " + ", ".join(f"{c} string" for c in names[1:]))
    got = mixing.take_mix(docs)
    assert got.columns == [*names, "copies"] and all(tuple(r)[3:9] == tuple("123456") for r in got.collect())
    again = mixing.take_mix(got)
    assert again.columns == got.columns
    assert mixing.take_mix(docs.limit(0)).count() == 0


def brute_licenses(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    starts, base, labels, score = [], set(), set(), 0.0
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        if at:
            base.add(label)
            score = 1.0
    for notice, label in licenses.NOTICES.items():
        t = notice.split()
        votes = [(i, q) for i in range(len(words) - 1) for q in range(len(t) - 1) if words[i : i + 2] == t[q : q + 2]]
        reach = math.floor(0.15 * (len(t) - 1) + 1e-9) + 4
        cuts = [k for k in range(1, len(votes)) if votes[k][0] - votes[k - 1][0] > reach]
        for low, high in zip([0, *cuts], [*cuts, len(votes)]):
            island, last = [], None
            for d, i, q in [*sorted((i - q, i, q) for i, q in votes[low:high]), (math.inf, 0, 0)]:
                if last is not None and d - last > 3:
                    share, span = len({q for _, q in island}) / (len(t) - 1), max(island)[0] - min(island)[0] + 2
                    if share >= 0.85 and span <= 2 * len(t):
                        labels.add(label)
                        score = max(score, share)
                    island = []
                island.append((i, q))
                last = d
    joined = [",".join(sorted(x)) for x in (base, base | labels)]
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), *joined, score


def test_licenses_match_brute_force(spark):
    rng = random.Random(43)
    known = [*licenses.PHRASES, *licenses.NOTICES]
    texts = [None, "", "...", "CC BY", "cc_by", "ccé by", "cc by cc by by"]
    for _ in range(150):
        words = []
        for _ in range(rng.randint(0, 4)):
            own = rng.choice(known).split()
            for _ in range(rng.choice([0, 0, 1, 3])):  # words that go, come or change
                k = rng.randrange(len(own) + 1)
                own[k : k + rng.randint(0, 1)] = rng.choices(["by", "license", "zzz"], k=rng.randint(0, 2))
            words += own + rng.choices(["the", "Ünder", "2", "all", "rights"], k=rng.randint(0, 9))
        texts.append("".join(rng.choice([w, w.upper()]) + rng.choice([" ", ", ", "\n", "_"]) for w in words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        found = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)
        *expect, score = brute_licenses(t)
        assert found == tuple(expect) and abs(r.score - score) < 1e-12, t
    assert sum(1 for r in got.values() if r.labels != r.base_labels) > 30


def test_scattered_grams_are_no_notice(spark):
    notice = next(n for n in licenses.NOTICES if n.startswith("permission")).split()
    drift = " ".join(f"{a} {b} x y z" for a, b in zip(notice, notice[1:]))
    spread = " ".join(f"{a} {b} " + "x " * 40 for a, b in zip(notice, notice[1:]))
    near = " ".join([*notice[:9], "or", "party", *notice[10:]])
    docs = spark.createDataFrame(list(enumerate([drift, spread, near, "x " * 50 + near + " y" * 50])), "doc_id long, text string")
    assert [r.labels for r in licenses.scan(docs).orderBy("doc_id").collect()] == ["", "", "mit", "mit"]


def tail(n, x, p):
    return 1.0 if x >= n * p else sum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(x + 1))


def test_kept_matches_brute_force(spark):
    rng = random.Random(44)
    rows = []
    for i in range(2400):
        lang, good = ("fr", i % 2) if i % 12 == 0 else ("en", int(i % 4 > 0))
        mark = "***" if not good and i % 8 else "!" if not good else "#" if i % 700 == 1 else ""
        rows.append((i, " ".join(w + mark for w in prose(rng, rng.choice([9, 30, 30, 45])).split()), lang, good))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    found = {r.doc_id: r for r in quality.apply_rules(docs, labels).collect()}
    values = {r.doc_id: r for r in quality.measures(docs).select("doc_id", *quality.rule_values()).collect()}
    tuning = {r.doc_id for r in quality.measures(docs).where(quality.is_tuning()).select("doc_id").collect()}
    own = [(i, lang, good) for i, _, lang, good in rows if not found[i].base_failed]
    assert 0.2 < len(tuning) / len(rows) < 0.3
    safe = {s: [i for i, lang, good in own if lang == s and good and i not in tuning] for s in ("en", "fr")}
    strata = sum(0.97 ** len(x) <= 0.05 for x in safe.values())
    cut = {}
    for lang in ("en", "fr"):
        part = [(i, good) for i, s, good in own if s == lang and i in tuning]
        n, chosen = sum(good for _, good in part), []
        for rule in quality.RULES:
            best = []
            for step, c in enumerate(quality.CUTOFFS):
                lost, caught = (sum(1 for i, good in part if good == g and values[i][rule] > c) for g in (1, 0))
                if caught and lost <= 0.03 / len(quality.RULES) * n:
                    best.append((caught, -lost, -step, c))
            if best:
                caught, kept, _, c = max(best)
                chosen.append((-caught, -kept, rule, c))
        tried = {}
        for _, _, rule, c in sorted(chosen):
            tried[rule] = c
            lost = sum(any(values[i][r] > tried[r] for r in tried) for i in safe[lang])
            if tail(len(safe[lang]), lost, 0.03) > 0.05 / max(strata, 1):
                break
            cut[lang, rule] = c
    assert cut and all(lang == "en" for lang, _ in cut)  # fr has too few labelled rows
    for i, _, lang, _ in rows:
        failed = ",".join(r for r in quality.RULES if values[i][r] > cut.get((lang, r), math.inf))
        assert (found[i].failed_rules, found[i].kept) == (failed, not found[i].base_failed and not failed)
    assert any(not r.kept and not r.base_failed for r in found.values())


def test_repeated_rows_and_copies_have_one_vote(spark):
    """Four times the rows, or four documents of each text, certify what the texts alone certify."""
    rng = random.Random(46)
    good = [prose(rng, 30) for _ in range(60)]
    many = good + [prose(rng, 30) for _ in range(340)]
    bad = [" ".join(w + "***" for w in prose(rng, 30).split()) for _ in range(40)]

    def cutoffs(texts, bad, times, step):
        rows = [(1000 * k * step + i, t, "en") for k in range(times) for i, t in enumerate([*texts, *bad])]
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        labels = spark.createDataFrame([(r[0], int("***" not in r[1])) for r in rows], "doc_id long, quality int")
        return sorted(map(tuple, quality.certified_cutoffs(quality.measures(docs), labels).collect()))

    assert cutoffs(good, bad, 1, 0) == cutoffs(good, bad, 4, 0) == cutoffs(good, bad, 4, 1) == []
    once = cutoffs(many, bad, 1, 0)
    assert once and once == cutoffs(many, bad, 4, 0) == cutoffs(many, bad, 4, 1)


def test_all_labelled_texts_count(spark):
    """Of 160 000 labelled texts of a stratum the rule loses 2 % of the good ones; of a certain 50 000 of them, 6 %."""
    some = "pmod(xxhash64(id, 3), 1000000) < 312500"
    lost = f"pmod(xxhash64(id, 5), 4) <> 0 and {some} and pmod(hash(id), 16) = 0"
    counts = ["0L as n_repeat_words", "100L as n_words", "400L as word_chars", "0L as n_bangs", "0L as n_capitals", "0L as n_dup_lines", "1L as n_lines", "100L as n_distinct"]
    rows = spark.range(160_000)
    measured = rows.selectExpr("id as doc_id", "id as text_key", "'en' as stratum", f"if(id % 4 = 0 or ({lost}), 100L, 0L) as n_symbols", *counts)
    labels = rows.selectExpr("id as doc_id", "int(id % 4 > 0) as quality")
    assert [r.rule for r in quality.certified_cutoffs(measured, labels).collect()] == ["symbols"]


def components(n, linked):
    parent = list(range(n))
    for j in range(n):
        for i in range(j):
            if linked(i, j):
                x, y = parent[i], parent[j]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    return parent


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(45)
    folder = str(tmp_path_factory.mktemp("corpus"))
    items = [(k, prose(rng, 40)) for k in range(4)]
    texts = [prose(rng, 120) for _ in range(40)]
    passage = prose(rng, 60)
    texts[5] += " " + passage
    texts[9] = passage + " " + texts[9]
    near = texts[3].split()
    near[50] = "changed"
    texts += [texts[2], texts[2], " ".join(near), None, "", "123 --- 4", texts[11] + " " + items[2][1], items[0][1]]
    rows = [(i, t, ["en", None][i % 5 == 0], ["s1", "s2", None, "s3"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    for name, made in (
        ("documents", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)),
        ("benchmark", spark.createDataFrame(items, "item_id long, text string")),
    ):
        made.write.parquet(f"{folder}/{name}.parquet")
    return folder, dict(items)


def test_every_stage_and_the_whole(spark, corpus):
    import corpus_pipeline

    folder, items = corpus
    docs = common.read(spark, folder, "documents")
    names, stages = docs.columns, dict(corpus_pipeline.STAGES)
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.Table(stage(spark, docs, folder)).df
        assert docs.columns == (names if name != "mixing" else [*names, "copies"])
        after = {r.doc_id: r for r in docs.collect()}
        ids = sorted(before)
        if name == "language_id":
            expect = {i for i in ids if re.search("[a-z]", before[i].text or "")}
        elif name == "simhash":
            sets = [word_shingles(before[i].text) for i in ids]
            group = components(len(ids), lambda i, j, s=sets: len(s[i] & s[j]) >= 0.8 * len(s[i] | s[j]))
            expect = {ids[k] for k, g in enumerate(group) if k == g}
            assert len(expect) == len(ids) - 3
        elif name == "suffix_array":
            expect = set(ids)
            digest = {r[0]: r[4] for r in suffix.brute_force([(i, before[i].text) for i in ids])}
            assert all(hashlib.sha256(after[i].text.encode()).hexdigest() == digest[i] and after[i].n_chars == len(after[i].text) for i in ids)
            assert len(after[9].text) < len(before[9].text)
        elif name == "decontamination":
            expect = {i for i in ids if not any(t in before[i].text for t in items.values())}
            assert len(expect) == len(ids) - 2
        else:
            copies = brute_mix([(i, before[i].source, len(WORD.findall(before[i].text))) for i in ids])
            expect = {i for i in ids if copies[i]}
            assert all(after[i].copies == copies[i] for i in expect)
        assert set(after) == expect, name
        if name != "suffix_array":
            assert all(after[i][c] == before[i][c] for i in expect for c in names)
        seen.append(name)
    assert seen == list(stages) and len(seen) == 5
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, docs.collect()))


def test_benchmark_passages_are_found_in_short_documents(spark, tmp_path):
    """The stage takes its directions from every document: where all are short, or all but one went before, none is passed over."""
    import corpus_pipeline

    rng = random.Random(53)
    item = prose(rng, 16)
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [(i, prose(rng, 20), "en", "web", 1) for i in range(8)]
    for rows in ([*clean, (8, "so " + item, "en", "web", 1)], [(8, item, "en", "web", 1)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        left = corpus_pipeline.benchmark_passages(spark, docs, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in left) == [r[0] for r in rows if r[0] < 8]
