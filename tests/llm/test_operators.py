"""Each operator against brute force, on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pixelmill.llm import chat, common, components, decontaminate, jaccard, licenses, mixing, ppm, pseudo, quality, simhash, suffix, weak

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, h string, words string, id string"
SYL = "the of an er th in on re and tion ble ing st ea".split()


def prose(rng, n):
    return " ".join("".join(rng.choices(SYL, k=rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


def rows():
    rng = random.Random(3)
    texts = [prose(rng, rng.choice([3, 12, 40, 90])) for _ in range(30)]
    passage = prose(rng, 60)
    texts += [texts[3], texts[3], texts[5] + " " + passage, passage + " " + texts[7], None, "", " \n\t ", "...", "a", "Ünï çödé " * 30]
    texts += [prose(rng, 6000), "\n".join(["same line here"] * 9), "aaaa" * 200, "🙂é" * 90]
    words = prose(rng, 80).split()
    near = words.copy()
    near[40] = "changed"
    texts += [" ".join(words), " ".join(near)]
    out = [(i, t, ["en", "fr", None][i % 3], ["s1", "s2", None, "s3"][i % 4]) for i, t in enumerate(texts)]
    out.append(out[4])  # a repeated row
    return out


@pytest.fixture(scope="module")
def docs(spark):
    # columns that clash with names used inside the operators
    return spark.createDataFrame([(*r, 1, "x", "y", "z", "w") for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return Counter(tuple(r) for r in df.collect())


def brute_components(fps, distance):
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_groups(docs, none):
    found = simhash.simhash_components(docs, k=3, distance=2).collect()
    fps = {i: simhash.fingerprint_of(t, 3) for i, t, *_ in rows()}
    expect = brute_components(fps, 2)
    assert len(found) == len(rows())
    for r in found:
        assert r.fp % 2**64 == fps[r.doc_id] and r.component_id == expect[r.doc_id]
    assert fps[34] == 0 and expect[36] == 34  # texts without words link at fingerprint zero
    assert simhash.simhash_components(none).count() == 0


def test_simhash_index_finds_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 8), np.uint64)
    f = np.unique(np.concatenate([base, *(base ^ flips[:, k] ^ flips[:, k - 1] for k in range(8))]))
    f = f[np.argsort(simhash.gray_rank(f))]
    labels = simhash.local_components(f, 2)
    expect = brute_components(dict(enumerate(map(int, f))), 2)
    assert labels.tolist() == [expect[i] for i in range(len(f))]
    for m in (2, 4):
        masks = simhash._masks(m)
        for _ in range(300):
            a = random.getrandbits(64)
            b = a
            for bit in random.sample(range(64), m):
                b ^= 1 << bit
            assert any((a ^ b) & mask == 0 for mask in masks)


def test_keep_one_of_each_group(docs):
    kept = {r.doc_id for r in simhash.keep_one_of_each_group(docs).collect()}
    expect = brute_components({i: simhash.fingerprint_of(t, 3) for i, t, *_ in rows()}, 2)
    assert kept == {i for i, c in expect.items() if i == c}


def word_shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_near_copies_by_jaccard(spark, docs, none):
    import corpus_pipeline

    rng = random.Random(21)
    texts = []
    for g in range(12):  # copies with words changed here and there, similarity around 0.8
        base = prose(rng, 200).split()
        texts.append(" ".join(base))
        for n in (1, 2, 4, 5, 9):
            words = base.copy()
            for i in rng.sample(range(200), n):
                words[i] = f"x{g}y{i}"
            texts.append(" ".join(words))
    texts += [prose(rng, 100) for _ in range(20)] + ["two words", "Two  words", "", None, " "]
    sets = [word_shingles(t) for t in texts]
    parent = list(range(len(texts)))
    for j in range(len(texts)):
        for i in range(j):
            if (not sets[i] and not sets[j]) or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                x, y = parent[i], parent[j]
                parent = [min(x, y) if p in (x, y) else p for p in parent]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, made, "").collect())
    assert got == [i for i, p in enumerate(parent) if p == i]
    odd = [(1, texts[0]), (1, texts[0]), (1, prose(rng, 50)), (None, texts[0]), (None, prose(rng, 50)), (None, texts[1])]
    got = jaccard.keep_one_of_each_group(spark.createDataFrame(odd, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([odd[0], odd[2], odd[4]])
    assert jaccard.keep_one_of_each_group(docs).columns == docs.columns and jaccard.keep_one_of_each_group(none).count() == 0


def test_near_copies_are_linked_by_simhash_first(spark, monkeypatch):
    rng = random.Random(5)
    f = [rng.getrandbits(64) for _ in range(60)]
    for x in f[:40]:  # a few bits off, on either side of the limit, and chains
        for n in (2, 5, 7):
            x ^= sum(1 << b for b in rng.sample(range(64), n))
            f.append(x)
    f += f[:5]  # other texts of the same fingerprint
    made = spark.createDataFrame([(i + 1, x - 2**64 if x >= 2**63 else x) for i, x in enumerate(f)], "t long, fp long")
    got = jaccard.fingerprint_pairs(made, 6).collect()
    parent = list(range(len(f) + 1))
    for a, b in [(i + 1, j + 1) for i, j in simhash.all_links_brute_force(f, 6)]:
        x, y = parent[a], parent[b]
        parent = [min(x, y) if p in (x, y) else p for p in parent]
    own = list(range(len(f) + 1))
    for r in got:
        x, y = own[r.a], own[r.b]
        own = [min(x, y) if p in (x, y) else p for p in own]
    assert own == parent and all(r.a < r.b for r in got)
    # leaders are not paired with what is joined already
    t, low = np.arange(4), np.zeros((4, jaccard.MINIMA), np.uint8)
    a, b = jaccard.led_pairs(t, np.array([0, 0, 2, 3]), low, 0.8)
    assert list(zip(a, b, strict=True)) == [(0, 2), (0, 3)]
    # without a round of MinHash, SimHash alone joins texts of nearly all words
    monkeypatch.setattr(jaccard, "ESTIMATES", ())
    words = prose(rng, 900).split()
    texts = [" ".join(words), " ".join([*words[:450], "changed", *words[451:]]), prose(rng, 900), ""]
    kept = jaccard.keep_one_of_each_group(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]


def test_texts_that_are_nearly_near_copies_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng = random.Random(8)
    words = prose(rng, 400).split()
    texts = []
    for _ in range(120):  # two of them share about 0.74 of their shingles
        own = list(words)
        for at in rng.sample(range(400), 6):
            own[at] = f"w{rng.getrandbits(60)}"
        texts.append(" ".join(own))
    texts += [f"{text} more" for text in texts[:20]]  # these do link
    asked, plain = spark.sparkContext.accumulator(0), jaccard._verified

    def counted(least):
        def run(batches):
            for batch in plain(least)(batches):
                yield batch

        def tee(batches):
            for batch in batches:
                asked.add(batch.num_rows)
                yield batch

        return lambda batches: run(tee(batches))

    monkeypatch.setattr(jaccard, "_verified", counted)
    monkeypatch.setattr(jaccard, "fingerprint_pairs", lambda nodes: spark.createDataFrame([], "a long, b long"))
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in jaccard.keep_one_of_each_group(made).collect()}
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (x.split() for x in texts)]
    links = [(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    own = list(range(len(sets)))
    for i, j in links:
        x, y = own[i], own[j]
        own = [min(x, y) if p in (x, y) else p for p in own]
    assert kept == {i for i, p in enumerate(own) if p == i}
    assert asked.value <= 1000, asked.value  # of 9730 pairs


def test_connected_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_suffix_matches_brute_force(docs, none):
    got = suffix.repeat_digests(docs).collect()
    expect = {r[0]: r for r in suffix.brute_force({r[0]: r for r in [x[:2] for x in rows()]}.values())}
    assert len(got) == len(rows())
    for r in got:
        assert tuple(r) == expect[r.doc_id]
    assert suffix.repeat_digests(none).count() == 0


def test_suffix_random_bytes(spark):
    rng = random.Random(9)
    blocks = ["".join(rng.choices("abé ", k=rng.randint(20, 180))) for _ in range(12)]
    texts = [(i, "".join(rng.choices(blocks, k=rng.randint(0, 5)))) for i in range(60)]
    got = suffix.repeat_digests(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), length=30, gram=8)
    assert sorted(map(tuple, got.collect())) == sorted(suffix.brute_force(texts, 30))


def test_suffix_repeated_rows_are_one_document(spark):
    rng = random.Random(11)
    passage = prose(rng, 60)
    texts = [(i, prose(rng, 50)) for i in range(6)]
    texts += [(6, prose(rng, 50) + passage), (7, passage + prose(rng, 50)), (None, prose(rng, 50))]
    expect = {r[0]: r for r in suffix.brute_force([(common.NULL_ID if i is None else i, t) for i, t in texts])}
    other = (3, prose(rng, 50))  # an id with two texts
    for rows_, more in ((texts, []), ([*texts, other], [other])):
        for parts in (1, 5):
            docs = spark.createDataFrame([r for r in rows_ for _ in range(3)], "doc_id long, text string").repartition(parts)
            got = suffix.repeat_digests(docs).collect()
            assert len(got) == 3 * len(rows_)
            known = Counter({expect[common.NULL_ID if i is None else i][1:]: 3 for i, _ in texts})
            known += Counter({suffix.brute_force([r])[0][1:]: 3 for r in more})
            assert Counter(tuple(r)[1:] for r in got) == known
            assert expect[7][2] > 100
            kept = Counter((r.doc_id, r.text) for r in suffix.remove_repeats(docs).collect())
            assert all(kept[r] == 3 for r in [*texts[:7], texts[8], *more])


def test_remove_repeats_keeps_rows_and_valid_text(docs):
    got = suffix.remove_repeats(docs)
    assert got.columns == docs.columns and got.count() == len(rows())
    texts = {r.doc_id: r.text for r in got.collect()}
    assert texts[34] is None and texts[30] == "" or len(texts[30]) < 100
    assert texts[0] == rows()[0][1]


def test_language_id(docs, none, spark):
    rng = random.Random(4)
    fr = [" ".join("".join(rng.choices(["le", "qué", "ion", "eau"], k=2)) for _ in range(40)) for _ in range(20)]
    en = [prose(rng, 40) for _ in range(20)]
    train = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(fr)] + [(50 + i, t, "en") for i, t in enumerate(en)], "doc_id long, text string, lang string")
    model = ppm.train(train)
    asked = spark.createDataFrame([(1, fr[0].upper()), (2, en[0]), (3, None), (4, "123 ---"), (5, ""), (6, "日本")], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.predict(asked, model).collect()}
    assert [got[i].lang_pred for i in range(1, 6)] == ["fr", "en", "und", "und", "und"]
    assert got[6].lang_pred in ("fr", "en") and all(0 <= r.score <= 1 for r in got.values())
    kept = ppm.keep_known(docs, model)
    assert kept.columns == docs.columns and {34, 35, 36, 37}.isdisjoint(r.doc_id for r in kept.collect())
    assert ppm.train(none) is None and ppm.predict(docs, None).where("lang_pred <> 'und'").isEmpty()


def test_ppm_code_length_is_exact():
    texts = [b"abab abba abab", b"baab ba"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    f, o = ppm.folded(data, np.array([0, 14, 21]))
    code, n = np.unique(ppm._grams(f, o), return_counts=True)
    model = ppm.build(["x"], np.zeros(len(code), int), code.astype(np.int64), n)
    counts = Counter()
    for k in range(len(o) - 1):
        own = bytes(f[o[k] : o[k + 1]])
        for i in range(3, len(own)):
            for order in range(4):
                counts[own[i - order : i], own[i]] += 1
    total = 0.0
    own = b"   abba ac"
    for i in range(3, len(own)):
        for order in (3, 2, 1, 0):
            seen = {s: c for (ctx, s), c in counts.items() if ctx == own[i - order : i]}
            if not seen:
                continue
            n_, d = sum(seen.values()), len(seen)
            if own[i] in seen:
                total -= np.log(seen[own[i]] / (n_ + d))
                break
            total -= np.log(d / (n_ + d))
        else:
            total += np.log(4)  # three letters seen and one class for all others
    got = model.code_lengths(np.frombuffer(b"abba ac", np.uint8), np.array([0, 7]))[0, 0]
    assert abs(got - total) < 1e-4


def test_ppm_learns_every_language_and_context(spark):
    rng = random.Random(31)
    rows_ = []
    for k in range(70):  # the last languages have the fewest texts
        own = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=4)) + chr(0xC0 + k % 64) + chr(0x400 + k) for _ in range(6)]
        rows_ += [(" ".join(rng.choices(own, k=30)), f"l{k:02}") for _ in range(8 - k // 10)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows_)], "doc_id long, text string, lang string")
    model = ppm.train(frame)
    assert len(model.langs) == 70
    got = {r.doc_id: r.lang_pred for r in ppm.predict(frame, model).collect()}
    assert [got[i] for i in range(len(rows_))] == [lang for _, lang in rows_]
    # a language costs the same alone, with all its contexts, as among many
    counts = Counter()
    for t, lang in rows_:
        raw = np.frombuffer(t.encode(), np.uint8)
        counts.update((lang, int(c)) for c in ppm._grams(*ppm.folded(raw, np.array([0, len(raw)]))))
    alone = [(c, n) for (lang, c), n in counts.items() if lang == "l69"]
    one = ppm.build(["l69"], np.zeros(len(alone), int), np.array([c for c, _ in alone]), np.array([n for _, n in alone]))
    raw = np.frombuffer(rows_[-1][0].encode(), np.uint8)
    at = np.array([0, len(raw)])
    assert abs(model.code_lengths(raw, at)[0, 69] - one.code_lengths(raw, at)[0, 0]) < 1e-3


def test_mixing(docs, none):
    got = mixing.mix(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows()}
    assert len(got) == len(rows()) and all(r.size == size[r.doc_id] and 0 <= r.taken <= 2 * r.size for r in got)
    per = {}
    for r in got:
        per.setdefault(r.source, [0, 0, r.source_size, r.target])
        per[r.source][0] += r.size
        per[r.source][1] += r.taken
    total = sum(s for s, *_ in per.values())
    assert abs(sum(t for *_, t in per.values()) - 1.5 * total) < 1e-6
    weight = dict(zip(["s1", "s2", "s3", None], [5, 2, 1, 5], strict=True))
    open_ = [t / weight[s] for s, (_, _, n, t) in per.items() if t < 2 * n - 1e-9]
    assert max(open_, default=0) - min(open_, default=0) < 1e-6
    assert sum(r.taken for r in got) <= 1.5 * total
    assert by_id(mixing.mix(docs)) == by_id(mixing.mix(docs.repartition(7)))
    assert mixing.mix(none).count() == 0
    assert "copies" in mixing.take_mix(docs).columns


def test_licenses(docs, none, spark):
    texts = ["ALL rights, reserved. cc by", "general public\nlicense license", "This work is licensed under the GNU General Public License, version 3.", None, "", "cc  by cc by"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (5, 2, 0, 3, "cc-by,reserved")
    assert got[1].n_base == 1 and "gpl-3.0" in got[2].labels and got[3].n_words == 0 and got[3].labels == ""
    assert got[5].n_base == 2 and got[5].last_word == 2 and got[4].score == 0
    assert licenses.scan(docs).count() == len(rows()) and licenses.scan(none).count() == 0


def test_quality_measures(docs, none):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    got = {r.doc_id: r for r in quality.measures(docs).collect()}
    for i, t, *_ in rows():
        t = t or ""
        w = word.findall(t)
        lines = [x for x in t.split("\n") if word.search(x)]
        seen = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if seen[tuple(w[k : k + 8])] > 1 for j in range(8)}
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
    labels = docs.selectExpr("doc_id", "1 as quality", "0 as toxic")
    assert quality.apply_rules(docs, labels).where("not base_failed and not kept").isEmpty()  # too few labels to certify anything
    assert quality.apply_rules(none, labels).count() == 0


def test_quality_rules_stand_texts_without_words(spark):
    """Empty, blank and null texts fail the fixed rules, whole rows of the result included; the learned rules still hold for the rest."""
    rng = random.Random(3)
    good = [(i, prose(rng, 30), "en", 1) for i in range(2500)]
    bad = [(5000 + i, " ".join(w + "***" for w in prose(rng, 30).split()), "en", 0) for i in range(300)]
    bare = [(9000 + i, t, s, i % 2) for i, t in enumerate([None, "", " \n\t ", "\n\n"]) for s in ("en", None)]
    docs = spark.createDataFrame([r[:3] for r in good + bad + bare], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in good + bad + bare], "doc_id long, quality int")
    got = quality.apply_rules(docs, labels).collect()
    assert len(got) == 2808 and {r.doc_id for r in got if r.kept} == set(range(2500))
    empty = [r for r in got if r.doc_id >= 9000]
    assert all((r.n_words, r.word_chars, r.base_failed, r.kept, r.failed_rules) == (0, 0, True, False, "") for r in empty)


def test_binomial_tail_is_exact(spark):
    import math

    from pyspark.sql import functions as F

    for n, x, p in ((50, 0, 0.1), (400, 3, 0.02), (5000, 10, 0.006), (10, 9, 0.1), (40_000, 1_150, 0.03)):
        got = spark.range(1).select(quality.binomial_tail(F.lit(n).cast("long"), F.lit(x).cast("long"), F.lit(p))).first()[0]
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(x + 1)]
        assert abs(got - (1.0 if x >= n * p else math.fsum(map(math.exp, logs)))) < 1e-9


def test_quality_certifies_with_enough_labels(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, 30), "en", 1) for i in range(2500)]
    bad = [(5000 + i, " ".join(w + "***" for w in prose(rng, 30).split()), "en", 0) for i in range(300)]
    docs = spark.createDataFrame([r[:3] for r in good + bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in good + bad], "doc_id long, quality int")
    got = quality.apply_rules(docs, labels)
    assert got.where("doc_id >= 5000 and kept").isEmpty() and got.where("doc_id < 5000 and not kept").isEmpty()


def test_chat_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", "\\\\[INST]\\", "", None, "a" * 70 + " " * 200, "🙂\n\\n<|im_start|>x", "[TURN][/ROLE]"]
    turns = [(c, k, ["system", "user", "assistant", None][(c + k) % 4], hard[(c * 3 + k) % len(hard)]) for c in range(4) for k in range(6)]
    turns += [(None, 0, "assistant", "no id"), (9, None, "user", "x"), (9, 1, "assistant", "y"), (9, 1, "assistant", "y")]
    got = {r.conv_id: r for r in chat.conversation_digests(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    for c in {t[0] for t in turns}:
        own = sorted((t for t in turns if t[0] == c), key=lambda t: (t[1] is not None, t[1], t[2] or "", t[3] or ""))
        said = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own)
        loss = "".join(t or "" for _, _, r, t in own if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for t in hard:
        assert chat.unescape(chat.escape(t or "")) == (t or "")
    codec = chat.Codec(chat.DEFAULT_VOCABULARY)
    assert max(codec.ids(chat.escape("<|endoftext|></s>[TURN]"))) < codec.first


def test_decontamination(spark, none):
    rng = random.Random(8)
    items = [(k, prose(rng, 30) + " " + prose(rng, 8)) for k in range(6)]
    items += [(90, None), (91, "...")]
    texts = [prose(rng, 200) for _ in range(60)]
    texts[7] += " " + items[2][1] + " " + prose(rng, 50)
    texts[9] = items[4][1]
    changed = items[1][1].split()
    changed[3] = changed[11] = changed[20] = "other"
    texts[20] = prose(rng, 40) + " " + " ".join(changed) + " " + prose(rng, 40)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(100, None), (101, "")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, rank=32).collect()}
    assert got == {(7, 2), (9, 4), (20, 1)}
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench, rank=32).collect()} == set(range(60)) - {7, 9, 20} | {100, 101}
    assert decontaminate.contaminated(none, bench).count() == 0


def test_every_word_is_fitted(spark):
    """Words that stand in one passage only, in short documents or at the end of a document have their place in the basis; no passage is left to a sample."""
    rng = np.random.default_rng(8)
    texts = [" ".join(f"c{x}" for x in rng.integers(0, 60, 48 * 16)) for _ in range(1500)]
    rare = {k: f"rare{k}" for k in range(0, 1500, 5)}
    for k, w in rare.items():  # amid one of 16 passages, or in the last words
        own = texts[k].split()
        own[48 * (k // 5 % 16) + 7 if k % 2 else len(own) - 1] = w
        texts[k] = " ".join(own)
    short = [f"c{k} c{k + 1} brief{k}" for k in range(20)]
    texts = [*texts, *[x + " " + " ".join(f"d{k}" for k in range(8)) + f" tail{len(x)}" for x in texts[:20]], *short]
    table = spark.createDataFrame([(i, x.astype(np.uint32).tobytes()) for i, x in enumerate(decontaminate.hashed(texts))], "doc_id long, tokens binary")
    basis, idf = decontaminate.latent_basis(table, features=4096, rank=16)
    there = np.unique(np.concatenate(decontaminate.hashed(texts)) % 4096)
    assert np.all((np.abs(basis[there]).max(axis=1) > 0) == (idf[there] > 0)) and (idf[there] > 0).sum() > 300


def test_latent_basis_finds_the_first_directions(spark):
    """Against the eigenvectors of all passages, the fit holds nearly as much of them; few documents, or none, need no directions."""
    rng = np.random.default_rng(9)
    texts = [" ".join(f"t{k % 12}w{x}" if u < 0.7 else f"c{x}" for x, u in zip(rng.integers(0, 40, n), rng.random(n), strict=True)) for k, n in enumerate(rng.integers(1, 400, 600))]
    lists = decontaminate.hashed(texts)
    table = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(lists)], "doc_id long, tokens binary")
    basis, idf = decontaminate.latent_basis(table, features=512, rank=12)
    rows = []
    for t in lists:
        parts = max(1, (len(t) + 24) // 48)
        for k in range(parts):
            a = np.bincount(t[k * len(t) // parts : (k + 1) * len(t) // parts] % 512, minlength=512) * idf
            rows.append(a / max(np.linalg.norm(a), 1e-9))
    a = np.array(rows)
    own = np.linalg.qr(basis / np.where(idf > 0, idf, 1)[:, None])[0]
    best = np.linalg.svd(a, compute_uv=False)[:12]
    assert basis.shape == (512, 12) and np.sum((a @ own) ** 2) > 0.97 * np.sum(best**2)
    assert decontaminate.latent_basis(table.limit(0), features=512, rank=12)[0].shape == (512, 0)


def test_decontamination_of_short_or_single_documents(spark):
    """Documents too short for a whole passage, and one document alone, are searched like any other."""
    rng = random.Random(24)
    item = prose(rng, 16)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    short = [(i, prose(rng, 20)) for i in range(9)] + [(9, "so " + item)]
    for rows in (short, [(3, item)], [(3, item), (4, item)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench, rank=16).collect()}
        assert got == {(i, 7) for i, t in rows if item in t}


def test_decontamination_drops_rows_without_id(spark):
    rng = random.Random(19)
    item = prose(rng, 40)
    clean = [prose(rng, 80) for _ in range(20)]
    rows_ = [(None, prose(rng, 20) + " " + item), (None, clean[0]), (1, item), (1, clean[1]), *enumerate(clean[2:], 2)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    got = decontaminate.drop_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), rank=16)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(r for r in rows_ if item not in r[1])


def test_decontamination_keeps_columns_of_any_name(spark):
    rng = random.Random(20)
    item = prose(rng, 40)
    rows_ = [(i, prose(rng, 60) + (" " + item if i == 3 else ""), i * 10, f"r{i}", "x") for i in range(12)]
    rows_ += [rows_[3], rows_[5], (12, None, 1, "r", "x"), (13, "", 1, "r", "x")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, _found long, _row_key string, _row string")
    got = decontaminate.drop_contaminated(docs, spark.createDataFrame([(7, item)], "item_id long, text string"), rank=16)
    assert got.columns == docs.columns and Counter(map(tuple, got.collect())) == Counter(r for r in rows_ if r[0] != 3)


def test_decontamination_misses_nothing_its_check_accepts(spark):
    rng = random.Random(17)
    common_words = SYL[:12]
    items = [(k, " ".join(rng.choices(common_words, k=rng.choice([12, 30, 60]))) + ". " + " ".join(rng.choices(common_words, k=8))) for k in range(12)]
    rare = [f"q{k}z" for k in range(8)]
    texts = []
    for k, (_, text) in enumerate(items * 8):  # copies with up to half of the words before the answer replaced by rare words
        w = text.split()
        for i in rng.sample(range(len(w) - 8), int((len(w) - 8) * (k // 12) / 14)):
            w[i] = rng.choice(rare)
        texts.append(prose(rng, rng.randint(0, 90)) + " " + " ".join(w) + " " + prose(rng, rng.randint(0, 90)))
    texts += [" ".join(rng.choices(rare, k=60)) for _ in range(8)] + [prose(rng, 200) for _ in range(150)]  # so the rare words weigh much
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), rank=32).collect()}
    expect, long = set(), decontaminate.common_subsequence
    for d, t in enumerate(decontaminate.hashed(texts)):
        for k, item in enumerate(decontaminate.hashed([x for _, x in items])):
            answer, width = item[-8:].tolist(), -(-len(item) // 8) + (len(item) < 24)
            for s in range(max(1, -(-len(t) // 8) - width + 1)):
                there = t[max(0, 8 * s - 8) : 8 * (s + width) + 8].tolist()
                share = long(item.tolist(), there) / len(item)
                if share >= 0.8 or (share >= 0.6 and long(answer, there) >= 0.8 * 8):
                    expect.add((d, k))
    assert got == expect and len(expect) > 80


def test_common_subsequence():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 70))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        assert decontaminate.common_subsequence(a, b) == row[-1]


@pytest.mark.parametrize("known_words", [7, 20_000])
def test_pseudo_likelihood(docs, none, known_words):
    """Against plain sums: the network's class, then the word's exact share of its class, whether its count travelled or was joined."""
    how = dict(buckets=512, number=16, own=8, width=8, known_words=known_words)
    model, flat, *_ = pseudo.fit(docs, **how)
    net = pseudo.Network(16, 8, flat)

    def hashes(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return common.words(raw, np.array([0, len(raw)]))[0]

    counts = Counter(w for _, t, *_ in rows() for w in hashes(t).tolist())
    mass = Counter()
    for w, n in counts.items():
        mass[int(model.of[w % 512])] += n
    got = {r.doc_id: r for r in pseudo.score(docs, **how).collect()}
    for i, t, *_ in rows()[:12]:
        w = hashes(t).tolist()
        c = [int(model.of[x % 512]) for x in w]
        total = 0.0
        for k in range(len(c)):
            near = [c[k + d] if 0 <= k + d < len(c) else 16 for d in pseudo.OFFSETS]
            total += net.log_probs(np.array([near]), np.array([c[k]]))[0] + np.log(counts[w[k]] / mass[c[k]])
        assert got[i].n_tokens == len(c) and abs(got[i].log_prob - total) < 1e-2 * max(1, len(c) / 50)
    assert got[34].n_tokens == 0 and got[34].log_prob == 0 and got[34].mean_log_prob is None
    found = Counter(r.doc_id for r in pseudo.score(docs, **how).collect())
    assert found == Counter(i for i, *_ in rows())
    assert pseudo.score(none, **how).count() == 0


def test_gradient_of_the_network():
    rng = np.random.default_rng(0)
    net = pseudo.Network(5, 4)
    near, target = rng.integers(0, 6, (7, 4)).astype(np.uint8), rng.integers(0, 5, 7)
    g = net.gradient(near, target)
    for k in rng.integers(0, len(net.flat), 12):
        old, step = net.flat[k], 1e-2
        net.flat[k] = old + step
        up = -net.log_probs(near, target).mean()
        net.flat[k] = old - step
        down = -net.log_probs(near, target).mean()
        net.flat[k] = old
        assert abs((up - down) / (2 * step) - g[k]) < 2e-3


def test_weak_labels(docs, none, spark):
    got = weak.classify(docs)
    assert got.count() == len(rows()) and weak.classify(none).count() == 0
    rng = random.Random(5)
    clean = [prose(rng, 60) for _ in range(120)]
    junk = [" ".join(w + "$$$" for w in prose(rng, 60).split()) for _ in range(30)]
    toxic = [prose(rng, 30) + " idiot scum moron " + prose(rng, 30) for _ in range(30)]
    texts = clean + junk + toxic
    found = {r.doc_id: r.kept for r in weak.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(found[i] for i in range(120)) and not any(found[i] for i in range(120, 180))


def test_expectation_maximisation_recovers_accuracies():
    rng = np.random.default_rng(0)
    n, bad = 4000, rng.random(4000) < 0.2
    votes = np.stack([np.where(rng.random(n) < a, ~bad, bad) for a in (0.98, 0.985, 0.99)], 1).astype(int)
    patterns, counts = np.unique(votes @ 3 ** np.arange(3), return_counts=True)
    _, chance, share = weak.expectation_maximisation(patterns, counts.astype(float), 3)
    assert abs(share - 0.2) < 0.03 and (chance[:, 0, weak.BAD] > 0.9).all()
