"""Fingerprints, language, chat, personal data, repeats and sketches against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from specloom.llm import catalog, chat, components, language, pii, repeats, simhash, sketches

from llm_cases import ODD


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows):
    prints, parent = [slow_fingerprint(t) for _, t in rows], list(range(len(rows)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return Counter((doc_id, f"{prints[i]:016x}", least.get(root(i))) for i, (doc_id, _) in enumerate(rows))


def test_simhash(spark, folder, documents, odd, empty):
    got = catalog.QUERIES["op2_simhash"](spark, folder).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == slow_components([d[:2] for d in documents])
    got = simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert Counter(map(tuple, got)) == slow_components(ODD)
    assert simhash.near_duplicates(empty).count() == 0
    stays = simhash.one_of_each(odd)
    assert stays.columns == odd.columns and stays.count() == len({c[2] for c in slow_components(ODD)})


def test_links_in_slices_connect_what_pairs_connect(spark):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(-(1 << 63), 1 << 63, 30)]
    prints = {x ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), False)) for x in base for _ in range(25)}
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    for rows in (4, 2048):
        found = components.components(simhash.links(df, 3, 6, rows), "a", "b").collect()
        roots = {r["node"]: r["root"] for r in found}
        all_prints, parent = sorted(prints), {x: x for x in prints}

        def top(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, a in enumerate(all_prints):
            for b in all_prints[:i]:
                if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
                    parent[max(top(a), top(b))] = min(top(a), top(b))
        assert all(roots.get(x, x) == top(x) for x in prints)


def test_components_of_a_long_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (7, 6), (6, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(300)}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_language(spark, folder, documents, odd, empty):
    got = {r.doc_id: r for r in catalog.QUERIES["op3_language"](spark, folder).collect()}
    assert len(got) == len(documents)
    held = [d for d in documents if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    assert {d[0] for d in held} == {i for i, r in got.items() if r.held_out}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(docs, F.lit(True))
    told = language.identify(odd, model).collect()
    assert len(told) == len(ODD)
    assert {r.lang_pred for r in told if r.doc_id in (1, 2, 6, 7)} == {"und"} and all(r.score == 0 for r in told if r.lang_pred == "und")
    assert language.identify(empty, model).count() == 0
    nothing = language.train(odd, F.lit(True))
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    kept = language.keep_identified(odd, model)
    assert kept.columns == odd.columns and 3 in {r.doc_id for r in kept.collect()} and kept.where("doc_id in (1, 2, 6, 7)").count() == 0


def test_texts_between_languages_are_ambiguous(spark, documents):
    rng, words = random.Random(3), {}
    for _, text, lang in documents:
        words.setdefault(lang, []).extend(text.split())
    said = lambda lang, n: " ".join(rng.choices(words[lang], k=n))
    learned = [(i, said(lang, rng.randrange(20, 80)), lang) for i, lang in enumerate(sorted(words) * 120)]
    model = language.train(spark.createDataFrame(learned, "doc_id long, text string, lang string"), F.lit(True))
    clean = [said(lang, rng.randrange(20, 80)) for lang in sorted(words) * 75]
    mixed = [" ".join(said(lang, 30) for lang in rng.sample(sorted(words), 2)) for _ in range(200)]
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz   ") for _ in range(rng.randrange(100, 500))) for _ in range(200)]
    sizes = (len(clean), len(mixed), len(junk))
    made = spark.createDataFrame(list(enumerate(clean + mixed + junk)), "doc_id long, text string")
    flagged, kept = np.zeros(sum(sizes), bool), np.zeros(sum(sizes), bool)
    flagged[[r.doc_id for r in language.identify(made, model).collect() if r.ambiguous]] = True
    kept[[r.doc_id for r in language.keep_identified(made, model).collect()]] = True
    assert (kept == ~flagged).all()
    of_clean, of_mixed, of_junk = (x.mean() for x in np.split(flagged, np.cumsum(sizes)[:2]))
    assert of_clean <= 0.05 and of_mixed >= 0.8 and of_junk >= 0.8, (of_clean, of_mixed, of_junk)


def test_band_of_small_samples():
    x = np.eye(8, 16, dtype=np.float32)
    assert language.band([], x[:0], 16) == language.band(["a", "b", "b"], x[:3], 16) == language.band(["a"] * 8, x, 16) == language.PLAIN_BAND


def test_low_quantile_over_all_resamples():
    rng = np.random.default_rng(4)
    for n, quantile in ((1, 0.01), (2, 0.01), (3, 0.6), (4, 0.3), (5, 0.5), (6, 0.1)):
        gaps = rng.random(n).tolist()
        drawn = [np.quantile(x, quantile, method="lower") for x in itertools.product(gaps, repeat=n)]
        assert math.isclose(language.low_quantile(gaps, quantile), np.exp(np.log(drawn).mean()) * min(1, quantile * (n + 1)))
    for n in (300, 301, 1000):
        gaps = rng.random(n).tolist()
        assert language.low_quantile(gaps, 0.01) == np.quantile(gaps, 0.01, method="lower")
    assert 0 <= language.low_quantile([0.0, 0.0, 0.5], 0.01) < 1e-6


def test_band_of_small_samples_is_measured():
    def sampled(shared, n):
        rng = random.Random(6)
        words = {k: ["".join(rng.choices(a, k=4)) for _ in range(40)] for k, a in (("a", "abcdefgh"), ("b", "ijklmnop"), ("both", "abcijk"))}
        labels = sorted("ab" * n)
        texts = [" ".join(rng.choices(words["both"] if rng.random() < shared else words[x], k=1)[0] for _ in range(40)) for x in labels]
        return labels, np.array([language.ngram_counts(t.encode(), 4096) for t in texts])

    for n in (3, 10, 40, 100):
        far, near = (language.band(*sampled(shared, n), 4096) for shared in (0.0, 0.8))
        assert far > 1.5 * near and language.PLAIN_BAND not in (far, near), (n, far, near)


def test_codewords_stay_apart():
    for n in (2, 3, 4, 5, 9, 40):
        code = language.codewords(n).astype(int)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 4 else 3)
    # a wrong bit or two is mended
    code = language.codewords(9).astype(float)
    model = language.Model([str(i) for i in range(9)], code.astype(np.int8), np.eye(code.shape[1]), np.zeros(code.shape[1]), np.ones(code.shape[1]), code.shape[1])
    for k in range(9):
        noisy = code[k].copy()
        noisy[[0, 5]] *= -1
        assert model.predict(noisy[None])[0][0] == k


def slow_chat(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    said = {}
    for conv, turns in out.items():
        learned = "".join(x for role, x in turns if role == "assistant")
        said[conv] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    return said


def test_chat(spark, folder):
    def read(df):
        return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}

    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    assert read(catalog.QUERIES["op5_chat"](spark, folder)) == slow_chat([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    odd = [(1, 0, None, None), (1, 0, "assistant", r"<\s> <\\/s>[\INST]"), (1, None, "assistant", "x" * 100_000), (None, 0, "user", "<s>"), (1, 0, None, None), (2, 1, "[INST]</s>", "<")]
    df = spark.createDataFrame(odd, "conv_id long, turn long, role string, text string").withColumns({"position": F.lit(1), "piece": F.lit("p")})
    assert read(chat.read_back(chat.format_turns(df))) == slow_chat(odd)
    assert chat.read_back(chat.format_turns(df.where("false"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "s>", "/", "a", "INST]"]), max_size=12).map("".join), st.sampled_from(["user", "a[INST]", "", "<s"]))
def test_every_turn_reads_back(text, role):
    assert chat.unescape(chat.escape(text)) == text
    assert not chat.MARK.search(chat.escape(text))
    piece, start, end = chat.render(role, text)
    assert chat.parse(piece)[:2] == (role, text) and chat.unescape(piece[start:end]) == text


def luhn(digits):
    values = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


SLOW = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def slow_spans(text):
    def fine(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": True, "ip": kind == "ip" and max(map(int, value.split("."))) <= 255, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]

    found = [(m.start(), k, m.end(), kind) for k, (kind, p) in enumerate(SLOW.items()) for m in re.finditer(p, text or "") if fine(kind, m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def test_personal_data(spark, folder, documents, odd, empty):
    rng = random.Random(4)
    parts = ["a@b.c", "x_y@z", "@d.e", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 010-9999", "+12", " ", "é", "card", "0000.0.0.00255", "9" * 40, "DE89370400440532013000", ".", "-", "\n", "%", "5500005555555559"]
    made = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))) for i in range(400)] + [(400, "9 " * 20_000), (401, "a." * 20_000 + "@"), (402, "10.0.0.1 " * 700), (403, "+1 2 3 " * 3000)]
    base = lambda r: ",".join(s for s in r.spans.split(",") if not s.startswith("iban"))
    for r in pii.digest(pii.find(spark.createDataFrame(made, "doc_id long, text string"))).collect():
        assert base(r) == slow_spans(made[r.doc_id][1]), made[r.doc_id][1][:200]
        assert r.base_sha256 == hashlib.sha256(base(r).encode()).hexdigest()
    got = {r.doc_id: r for r in catalog.QUERIES["op6_pii"](spark, folder).collect()}
    for doc_id, text, _ in documents:
        want = slow_spans(text)
        assert got[doc_id].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[doc_id][f"n_{k}"] for k in SLOW] == [len(re.findall(f"(?:^|,){k}:", want)) for k in SLOW]
    assert Counter(r.doc_id for r in pii.find(odd).collect()) == Counter(i for i, _ in ODD)
    assert pii.digest(pii.find(empty)).count() == 0


def test_scores_and_account_numbers(spark):
    text = "bank account DE89370400440532013000, not DE89370400440532013001; call +1 555 010 9999 or +1 555 010 9998"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    assert [(s.kind, text[s.start : s.end], s.score) for s in spans[1]] == [("iban", "DE89370400440532013000", 1.0), ("phone", "+1 555 010 9999", 0.9), ("phone", "+1 555 010 9998", 0.6)]
    shown = pii.with_spans(df).select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).collect()
    assert shown[0].t == "bank account [IBAN], not DE89370400440532013001; call [PHONE] or [PHONE]" and shown[1].t is None


def test_account_numbers_before_words(spark):
    plain, grouped, spaced = "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947"
    texts = {
        1: (f"{plain} Kontoinhaber", [plain]), 2: (f"{grouped} BIC X", [grouped]), 3: (f"an {spaced} 2024 EUR", [spaced]),
        4: (f"é🎉 {plain} {grouped} AND {spaced}", [plain, grouped, spaced]), 5: (f"{plain}X {plain[:-1]} x{plain}", []),
        6: (f"MT84 {plain} ABCDE. ", [plain]), 7: (f"{plain} {plain}", [plain, plain]), 8: (f"DE89 3704 0044 0532 0130 01 {spaced}\nOK", [spaced]),
    }
    df = spark.createDataFrame([(i, t) for i, (t, _) in texts.items()], "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [r.text[s.start : s.end] for s in r.spans if s.kind == "iban"] == texts[r.doc_id][1], r.text
    shown = pii.with_spans(df.where("doc_id = 1")).select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).first()
    assert shown.t == "[IBAN] Kontoinhaber"


def test_context_reaches_over_unconfirmed_matches(spark):
    far = "credit card " + "x" * 40
    rows = [(1, "credit card (12/26): 4111111111111111"), (2, f"{far} 12/26: 4111111111111111"), (3, "credit card " + "1.2." * 8 + "/4111111111111111"), (4, "é card " + "12/" * 11 + "4111111111111111")]
    got = {r.doc_id: [s.score for s in r.spans if s.kind == "card"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [1.0], 2: [0.8], 3: [1.0], 4: [1.0]}


def slow_repeats(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        left = np.frombuffer(t, np.uint8)[~gone].tobytes() if t else b""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))) == 1)
        out.append((doc_id, len(t), int(gone.sum()), len(edges), hashlib.sha256(left).hexdigest()))
    return Counter(out)


def odd_repeats():
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdefghij é") for _ in range(n))
    p, q = make(700), make(330)
    rows = [make(500) + p[:450] + make(80), p[100:] + make(300), make(900), q + make(40) + q, "a" * 500, "ab" * 150 + make(50), make(150), p[200:400] + make(10), p[:399] + "!" + p[400:], "x" + p[201:402], "abc" * 90]
    return [*enumerate(rows), *ODD[:3], *ODD[4:], (3, ODD[3][1][:3000])]


def test_repeats(spark, folder, documents, odd, empty):
    got = catalog.QUERIES["op7_repeats"](spark, folder).collect()
    assert Counter(map(tuple, got)) == slow_repeats([d[:2] for d in documents], 200)
    rows = odd_repeats()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("i"), "packed": F.lit("p")})
    want = slow_repeats(rows, 200)
    for how in ({}, {"hot": 0}, {"chunk_bytes": 100}, {"symbol": 50}):
        assert Counter(map(tuple, repeats.digest(repeats.remove_repeats(df, **how)).collect())) == want, how
    assert repeats.remove_repeats(empty).count() == 0
    whole = repeats.remove_repeats(odd, carry=("lang", "th"), as_text=True).select("doc_id", "kept", "rest.*")
    assert whole.columns == ["doc_id", "kept", "lang", "th"] and whole.count() == len(ODD)


def test_merged_transforms_find_what_counting_finds():
    rng = random.Random(2)
    for _ in range(20):
        made = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 40))) for _ in range(rng.randrange(2, 9))]
        seen = Counter(c[i : i + 8] for c in made for i in range(len(c) - 7))
        for shards in (1, 2, 3):
            for q in (2, 4, 8):
                places, s = repeats.repeated(made, 8, q, shards)
                want = [int(s.begins[k]) + i for k, c in enumerate(made) for i in range(len(c) - 7) if seen[c[i : i + 8]] > 1]
                assert places.tolist() == want


def test_sketches(spark, folder, documents, odd, empty):
    def check(rows, got):
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = Counter()
        for k, (doc_id, text) in enumerate(rows):
            text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
            edited = text[: len(text) - len(text) // 4] + after[: len(text) // 4]
            want[(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)

    got = catalog.QUERIES["op9_sketches"](spark, folder).collect()
    check([d[:2] for d in documents], got)
    assert np.mean([r.near_edited for r in got]) > 0.4 and np.mean([r.near_next for r in got]) < 0.1
    singles = [r for r in ODD if r != ODD[4]] + [ODD[4]]  # order among equal ids is by compressed bytes
    check(singles, sketches.versions(spark.createDataFrame(singles, "doc_id long, text string").withColumn("run", F.lit(1))).collect())
    got = sketches.versions(odd).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in ODD)
    same = [r.fingerprint for r in got if r.doc_id in (4, 5)]
    assert len(same) == 3 and len(set(same)) == 1
    assert sketches.versions(empty).count() == 0
    one = sketches.versions(odd.where("doc_id = 9")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


@settings(max_examples=150, deadline=None)
@given(st.sets(st.integers(0, (1 << 48) - 1), max_size=60), st.sets(st.integers(0, (1 << 48) - 1), max_size=60), st.sets(st.integers(0, (1 << 48) - 1), max_size=200))
def test_peeling_recovers_the_difference(a, b, both):
    key = lambda xs: [x << 16 | sketches.check(x) for x in xs]
    one, other = key(a | both), key(b | both)
    assert sketches.difference(one, other) == (set(one) - set(other), set(other) - set(one))
    found = sketches.peel(sketches.sketch(one, 24), sketches.sketch(other, 24))
    assert found is None or found == (set(one) - set(other), set(other) - set(one))


def test_three_digests_in_the_same_cells_are_not_taken_for_one():
    """Their XOR passed the former check bits; found by the test above in one of its runs."""
    a, b = {4398046511103, 8796093022207}, {35184372088831}
    key = lambda xs: [x << 16 | sketches.check(x) for x in xs]
    assert sketches.difference(key(a), key(b)) == (set(key(a)), set(key(b)))
    assert sketches.peel(sketches.sketch(key(a), 24), sketches.sketch(key(b), 24)) is None
