"""Each operator against a brute-force version and on the odd inputs its docstring defines."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import contamination, exact_dedup, html_blocks, html_extract, html_training, mixing, minhash, pii, quality, substring, token_counts, warc
from codeloom.llm.common import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows, schema=SCHEMA):
    full = [r if len(r) == 5 else (r[0], r[1], "en", "src1", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, schema)


def corpus(seed=5, n=60):
    """Documents with copies, near copies, shared passages, one long text and odd white space."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(300)]
    prose = lambda k: " ".join(r.choices(vocabulary, k=k))
    passage = prose(50)
    out = []
    for i in range(n):
        text = prose(r.choice([1, 3, 20, 60, 120]))
        if i % 5 == 1:
            text = out[-1]
        elif i % 5 == 2 and len(out[-1].split()) > 30:
            words = out[-1].split()
            words[r.randrange(len(words))] = "changed"
            text = " ".join(words)
        elif i % 5 == 3:
            text = f"{prose(10)}\n{passage}\t {prose(7)} "
        out.append(text)
    out += ["", " \t\n", None, "one", "a a a " * 60, prose(4000), passage.upper()]
    return list(enumerate(out))


def rows_of(df, *cols):
    return {r[cols[0]]: tuple(r[c] for c in cols[1:]) for r in df.select(*cols).collect()}


# -- exact dedup


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_equals_brute_force(spark, weak):
    docs = corpus()
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    digest = (lambda t: F.pmod(F.crc32(t.cast("binary")), F.lit(3)).cast("string").cast("binary")) if weak else exact_dedup.sha256_digest
    got = rows_of(exact_dedup.duplicates(frame(spark, docs), digest=digest), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for i, t in docs:
        g = groups[t or ""]
        assert got[i] == (max(g), len(g), i == max(g), hashlib.sha256((t or "").encode()).hexdigest())
    smallest = rows_of(exact_dedup.duplicates(frame(spark, docs), keep="smallest"), "doc_id", "keep_id")
    assert all(smallest[i] == (min(groups[t or ""]),) for i, t in docs)


def test_exact_dedup_hot_group_null_ids_repeated_rows_and_extra_columns(spark):
    n = 3 * exact_dedup.COMPARE_ROWS
    rows = [(i, "same text", "en", "s", 1) for i in range(n)] + [(None, "x", "en", "s", 1), (7, "y", "en", "s", 1), (7, "y", "en", "s", 1), (9000, None, None, None, None)]
    docs = frame(spark, rows).withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("salt", F.lit(2))
    found = exact_dedup.duplicates(docs)
    assert found.count() == len(rows)
    assert found.filter("keep_id = 1535 and group_size = 1536").count() == n
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in kept.collect()) == [-1, 7, 1535, 9000]
    assert exact_dedup.duplicates(frame(spark, [])).count() == 0


# -- near dedup


def shingles(text):
    words = [bytes(w) for w in (text or "").encode().lower().split()]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_brute(docs, num, den):
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y]:
                shared = len(sets[x] & sets[y])
                if den * shared >= num * (len(sets[x]) + len(sets[y]) - shared):
                    a, b = sorted((root(x), root(y)))
                    up[b] = a
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    docs = corpus(8)
    got = rows_of(minhash.near_duplicates(frame(spark, docs)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute(docs, 85, 100)


def test_near_duplicates_in_many_blocks(spark, monkeypatch):
    r = random.Random(2)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(80):
        words = list(base)
        for _ in range(r.randint(0, 4)):
            words[r.randrange(200)] = f"x{r.randrange(10**6)}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(minhash, "BLOCK", 20)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 1500)
    got = rows_of(minhash.near_duplicates(frame(spark, docs)), "doc_id", "n_shingles", "component_id", "kept")
    assert got == near_brute(docs, 85, 100)


def test_near_duplicates_odd_rows(spark):
    rows = [(None, "a b c d e f g"), (3, "a b c d e f g"), (3, "a b c d e f g"), (1, "A B  C\td e f g"), (5, None), (6, ""), (8, "a b")]
    got = sorted(map(tuple, minhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 3, None, True), (3, 3, 1, False), (3, 3, 1, False), (1, 3, 1, True), (5, 0, 5, True), (6, 0, 6, True), (8, 1, 8, True)], key=str)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert sorted((r["doc_id"] or 0) for r in minhash.distinct_documents(frame(spark, rows)).collect()) == [0, 1, 5, 6, 8]


def test_estimates_follow_similarity():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 63, 1000, np.uint64)
    for share in (0.5, 0.8, 0.9):
        b = a.copy()
        b[: round(1000 * (1 - share) / (1 + share))] = r.integers(0, 1 << 63, round(1000 * (1 - share) / (1 + share)), np.uint64)
        pack = [np.frombuffer(minhash.signature(minhash.minima(x)).ljust(64, b"\0"), ">u8").astype(np.uint64)[None, :] for x in (a, b)]
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(minhash.estimates(*pack)[0, 0] - true) < minhash.MARGIN


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(5, 5)]
    up = {}

    def root(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for i in up}


# -- substring dedup


def substring_brute(docs, window):
    starts = Counter()
    words = {k: (t or "").encode().split() for k, (_, t) in enumerate(docs)}
    for w in words.values():
        for i in range(len(w) - window + 1):
            starts[tuple(w[i : i + window])] += 1
    out = []
    for k, (i, _) in enumerate(docs):
        w, gone = words[k], set()
        for at in range(len(w) - window + 1):
            if starts[tuple(w[at : at + window])] > 1:
                gone.update(range(at, at + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 8])
def test_substring_dedup_equals_brute_force(spark, window):
    docs = corpus(11) + [(500, "b a " * 40), (501, "x " + "b a " * 30), (500, "again the same id"), (None, "no id at all")]
    got = sorted(map(tuple, substring.removal_digests(frame(spark, docs), window=window).collect()), key=str)
    assert got == sorted(substring_brute(docs, window), key=str)


def test_substring_dedup_of_nothing(spark):
    assert substring.removal_digests(frame(spark, [])).count() == 0
    assert [tuple(r)[1:3] for r in substring.removal_digests(frame(spark, [(1, None)])).collect()] == [(0, 0)]


# -- tokens


def test_token_counts_equal_the_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    r = random.Random(3)
    odd = ["a", "B", "é", "́", "Σ", "İ", "'s", "9", ".", " ", "\t", "\n", "\x0b", "\x0c", "\x1c", "\x85", " ", "<|endoftext|>", "中", "😀"]
    texts = [None, "", "  ", "word " * 30_000, "x" * 5000] + ["".join(r.choices(odd, k=r.randint(0, 20))) for _ in range(300)]
    docs = frame(spark, list(enumerate(texts))).withColumn("_text", F.lit("clash"))
    got = rows_of(token_counts.token_counts(docs, "word_bpe_49k.json"), "doc_id", "n_bytes", "n_tokens", "over_limit")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, x in enumerate(texts):
        n = len(t.encode(x or "", add_special_tokens=False).ids)
        assert got[i] == (len((x or "").encode()), n, n > 2048)
    assert token_counts.token_counts(frame(spark, []), "word_bpe_49k.json").count() == 0


def test_token_counts_of_a_sentencepiece_model(spark):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["Some words here.", None, "Größe und  Maß"]
    got = rows_of(token_counts.token_counts(frame(spark, list(enumerate(texts))), "piece_bpe_32k.model"), "doc_id", "n_tokens")
    assert got == {i: (len(sp.encode(x or "")),) for i, x in enumerate(texts)}


def test_token_cache_limit_changes_nothing(monkeypatch):
    import public_tokenizers

    texts = [" ".join(f"w{i * j}" for j in range(40)).encode() for i in range(50)]
    path = public_tokenizers.path("word_bpe_49k.json")
    want = token_counts.Counter(path).count(texts)
    monkeypatch.setattr(token_counts, "CACHE_PIECES", 60)
    c = token_counts.Counter(path)
    assert [c.count([t])[0] for t in texts] == want


# -- archives


def test_archives_round_trip(spark):
    big = "<p>" + "text of a page " * 20 + "</p>"
    pages = [(i, f"http://h/{i}", f"{big}{i % 4}") for i in range(40)] + [(50, "http://h/é\n%", None), (51, None, ""), (52, "u", "short"), (53, "u", "short"), (3, "again", f"{big}3"), (None, "n", big), (60, "ü", "é" * 200_000)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    manifest = warc.write_archives(df)
    back = warc.read_archives(manifest).collect()
    assert sum(r["n_records"] for r in manifest.collect()) == len(pages) == len(back)
    assert all(r["intact"] for r in back)
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(i, first.get(h, i))
    want = Counter()
    for i, u, h in pages:
        b = (h or "").encode()
        at = first.get(h, i) if len(b) >= 100 else i
        revisit = at is not None and at != i
        want[(i, u or "", len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", at if revisit else None, None if revisit else b)] += 1
    got = Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in back)
    assert got == want
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_archive_starts_with_its_dictionary(tmp_path, monkeypatch):
    import struct

    import zstandard

    monkeypatch.setattr(warc, "SAMPLE_BYTES", 4000)
    a = warc.Archive(f"file://{tmp_path}")
    records = [warc.record(i, "u", b"<p>page %d</p>" % i * 20, 10, "d", None, None, "2024-01-01T00:00:00Z") for i in range(30)]
    for x in records:
        a.add(x)
    path, n, size, dictionary = a.close()
    data = open(path.removeprefix("file://"), "rb").read()
    assert n == 30 and size == len(data)
    magic, length = struct.unpack("<II", data[:8])
    assert (magic, length) == (warc.SKIPPABLE, dictionary)
    assert list(warc.records_of(path)) == records
    assert data[8 + length : 12 + length] == zstandard.FRAME_HEADER


# -- personal data


def pii_brute(text):
    text = text or ""
    out = []
    for kind in pii.BASE:
        for m in re.finditer(pii.PATTERN[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and not all(int(p) <= 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                if not 16 <= len(digits) <= 19:
                    continue
                total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
                if total % 10:
                    continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans_equal_brute_force(spark):
    r = random.Random(9)
    parts = ["a.b@c.d", "@", "x@y", ".com", "1.2.3.4", "256.1.1.1", "001.02.3.255", "4465758382889437", "4111 1111 1111 1111", "-", " ", "+1 (743) 555-3824", "+", "12", "é", "😀", "..", "_d@e.f.g", "()", "\n", "7"]
    texts = ["".join(r.choices(parts, k=r.randint(0, 12))) for _ in range(800)]
    texts += [None, "", "a" * 30_000, "1" * 30_000, "1 " * 30_000, "1." * 20_000, "a.a@" * 5000]
    got = rows_of(pii.report(frame(spark, list(enumerate(texts)))), "doc_id", "spans", "base_sha256", "n_email", "n_ip", "n_card", "n_phone")
    for i, t in enumerate(texts):
        want = pii_brute(t)
        base = [s for s in got[i][0].split(",") if s.split(":")[0] in pii.BASE]
        assert base == want, t
        assert got[i][1] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i][2:] == tuple(sum(s.startswith(k + ":") for s in want) for k in pii.BASE)


def test_pii_checksums_and_context(spark):
    texts = ["pay to GB82 WEST 1234 5698 7654 32 today", "pay to GB83 WEST 1234 5698 7654 32 today", "number 078-05-1120 here", "her ssn is 078-05-1120", "mail me: a@b.org"]
    got = rows_of(pii.report(frame(spark, list(enumerate(texts)))), "doc_id", "spans", "scores")
    assert got == {0: ("iban:7:34", "90"), 1: ("", ""), 2: ("", ""), 3: ("national_id:11:22", "80"), 4: ("email:9:16", "95")}
    masked = rows_of(pii.masked(frame(spark, [(1, "é a@b.org, 1.2.3.4!"), (2, None)])), "doc_id", "text")
    assert masked == {1: ("é <email>, <ip>!",), 2: (None,)}
    assert pii.report(frame(spark, [])).count() == 0


# -- decontamination


def verdicts(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("key", F.lit("clash"))
    return rows_of(contamination.contaminated(frame(spark, docs), bench), "doc_id", "contaminated", "items")


ITEM = "A farmer named Anna has 12 apples and gives 5 of them to her neighbour Paul who already had 12 pears in the basket."


def test_decontamination_finds_reparameterised_questions(spark):
    other = ITEM.replace("Anna", "Greta").replace("Paul", "Igor").replace("12", "90").replace("5", "31")
    torn = ITEM.replace("12 apples", "90 apples").replace("12 pears", "44 pears").replace("5", "31")
    docs = [(1, f"Intro words. {ITEM} More."), (2, f"x y z {other}"), (3, torn), (4, "nothing of the kind " * 30), (5, None), (6, ""), (7, ITEM.upper()), (8, f"Intro words. {ITEM} More.")]
    got = verdicts(spark, docs, [(10, ITEM), (11, "too short"), (12, None), (10, ITEM)])
    assert {i for i, v in got.items() if v[0]} >= {1, 2, 8}
    assert not got[3][0] and not got[4][0] and not got[5][0] and not got[6][0]
    assert got[1][1] == "10"


def test_decontamination_judges_slots_by_window(spark):
    """Long copies with one edited name, and values that become equal, are found; see also the torn copy above."""
    long = ("The river port of Paris has seen many boats carry grain and wine to the sea since the old days when people there built "
            "a bridge near Paris out of heavy stone and wood and then sold fresh bread at a market beside it every "
            "week so that all who came to Paris by boat could eat well.")
    edited = long.replace("near Paris", "near Lyon")
    other = long.replace("Paris", "Rome").replace("near Rome", "near Lyon")
    merged = ITEM.replace("Anna", "Greta").replace("Paul", "Greta").replace("12", "31").replace("5", "31")
    got = verdicts(spark, [(1, f"Some words. {edited} More."), (2, other), (3, merged), (4, "nothing of the kind " * 30)], [(10, ITEM), (20, long)])
    assert got == {1: (True, "20"), 2: (True, "20"), 3: (True, "10"), 4: (False, "")}


def test_decontamination_short_items_and_empty_tables(spark):
    docs = [(1, "say the quick brown fox jumps today"), (2, "the quick brown fox sleeps")]
    assert verdicts(spark, docs, [(1, "the quick brown fox jumps")]) == {1: (True, "1"), 2: (False, "")}
    assert verdicts(spark, docs, []) == {1: (False, ""), 2: (False, "")}
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert contamination.contaminated(frame(spark, []), bench).count() == 0
    docs = frame(spark, [(1, ITEM), (1, ITEM), (None, "clean text"), (3, None)]).withColumn("item", F.lit(1)).withColumn("place", F.lit(2))
    kept = contamination.decontaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "None"]


def test_decontamination_joins_by_shuffle_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BROADCAST_BYTES", 0)
    assert verdicts(spark, [(1, ITEM), (2, "clean")], [(4, ITEM)]) == {1: (True, "4"), 2: (False, "")}


# -- mixing


def water(budget, children):
    """Shares by raising a level until the budget is used."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, mid * w) for c, w in children.values()) < budget:
            lo = mid
        else:
            hi = mid
    return {k: min(c, hi * w) for k, (c, w) in children.items()}


def test_budgets_redistribute_among_siblings_first(spark):
    leaves = [("web", "en", "s1", 100), ("web", "en", "s2", 10_000), ("web", "de", "s3", 5), ("books", "en", "s4", 300), ("code", "", "s5", 9000)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    got = {r["source"]: r["budget"] for r in mixing.budgets(df, total=8000, epochs=2).collect()}
    cap = {s: 2 * t for _, _, s, t in leaves}
    dom = water(8000, {"web": (cap["s1"] + cap["s2"] + cap["s3"], 5), "books": (cap["s4"], 3), "code": (cap["s5"], 2)})
    lang = water(dom["web"], {"en": (cap["s1"] + cap["s2"], 6), "de": (cap["s3"], 2)})
    want = water(lang["en"], {"s1": (cap["s1"], 1), "s2": (cap["s2"], 1)}) | {"s3": lang["de"], "s4": dom["books"], "s5": dom["code"]}
    assert all(abs(got[s] - want[s]) <= 3 for s in want)
    assert 7990 <= sum(got.values()) <= 8000


def test_mixture_takes_prefixes_of_seeded_epochs(spark):
    r = random.Random(1)
    rows = [(i, " ".join(["w"] * r.randint(0, 30)), r.choice(["en", "de", None]), r.choice(["src0", "src1", "src2", "other", None]), 1) for i in range(200)] + [(900, None, None, None, None), (901, " a  b ", "en", "src0", 1)]
    docs = frame(spark, rows).withColumn("epoch", F.lit("clash")).withColumn("bucket", F.lit(0))
    got = mixing.mixture(docs).collect()
    plan = {tuple(r[c] for c in mixing.LEAF): r["budget"] for r in mixing.budgets(docs.select(mixing.domain_of(F.col("source")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), mixing.n_tokens(F.col("text")).alias("t")).filter("t > 0").groupBy(*mixing.LEAF).agg(F.sum("t").alias("tokens"))).collect()}
    taken = Counter()
    for x in got:
        taken[tuple(x[c] for c in mixing.LEAF)] += x["take_tokens"]
        assert 0 < x["take_tokens"] <= x["n_tokens"]
    assert {k: v for k, v in plan.items() if v} == dict(taken)
    order = lambda x: hashlib.md5(f"{mixing.SEED}:{x['epoch']}:{x['id']}".encode()).hexdigest()
    for leaf in plan:
        for epoch in range(mixing.EPOCHS):
            own = sorted((x for x in got if tuple(x[c] for c in mixing.LEAF) == leaf and x["epoch"] == epoch), key=order)
            assert all(x["take_tokens"] == x["n_tokens"] for x in own[:-1])
            if own and epoch + 1 < mixing.EPOCHS and sum(x["epoch"] == epoch + 1 and tuple(x[c] for c in mixing.LEAF) == leaf for x in got):
                assert own[-1]["take_tokens"] == own[-1]["n_tokens"]
    out = mixing.mixed(docs)
    assert sum(len(WORD.findall(x["text"])) for x in out.collect()) == sum(taken.values())
    assert mixing.mixed(frame(spark, [])).count() == 0
    assert mixing.mixture(frame(spark, [(1, None), (2, "")])).count() == 0


# -- quality


def test_weak_labels_recover_planted_accuracies():
    r = random.Random(7)
    n = len(quality.LABELLERS)
    truth_of = [r.random() < 0.8 for _ in range(6000)]
    right = [0.95 if i % 2 else 0.85 for i in range(n)]
    patterns = Counter()
    for good in truth_of:
        v = []
        for i, (_, _, vote) in enumerate(quality.LABELLERS):
            correct = good == (vote == quality.GOOD)
            fires = r.random() < (0.6 * right[i] if correct else 0.3 * (1 - right[i]))
            v.append(str(vote) if fires else str(quality.ABSTAIN))
        patterns["".join(v)] += 1
    prior, accuracy = quality.estimate(dict(patterns))
    assert 0.6 < prior <= 0.9
    assert (accuracy > 0.7).all() and (accuracy[1::2] > accuracy[:-1:2]).all()


def test_quality_keeps_prose_and_rejects_junk(spark):
    r = random.Random(1)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(800)]
    prose = lambda: " ".join(r.choices(words, k=r.randint(20, 90))).capitalize() + "."
    good = [prose() for _ in range(400)]
    bad = [" ".join(w + r.choice(["$$$", "***", "%%%"]) for w in r.choices(words, k=50)) for _ in range(60)] + [" ".join(w.upper() + "!!" for w in r.choices(words, k=50)) for _ in range(60)] + [" ".join(" ".join([w] * 7) for w in r.choices(words, k=10)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)] + [(9000, None), (9001, ""), (9002, " \n"), (None, good[0]), (9003, prose() * 400)]
    docs = frame(spark, rows).withColumn("pattern", F.lit("clash")).withColumn("score", F.lit("clash"))
    model = quality.train(docs)
    got = {r["doc_id"]: r["kept"] for r in quality.scored(docs, model).collect()}
    assert np.mean([got[i] for i in range(400)]) > 0.99
    assert np.mean([got[i] for i in range(400, 580)]) < 0.05
    assert not got[9000] and not got[9001] and not got[9002] and got[None] and got[9003]
    assert quality.filtered(docs).columns == docs.columns
    assert quality.filtered(frame(spark, [])).count() == 0
    few = frame(spark, [(1, good[0]), (2, bad[0]), (3, None)])
    assert [r["doc_id"] for r in quality.filtered(few).collect()] == [1]


# -- html


@pytest.fixture(scope="module")
def crf():
    return html_extract.fit(html_training.training_pages(700), rounds=100)


def test_crf_likelihood_equals_enumeration():
    import itertools

    r = np.random.default_rng(0)
    crf = html_extract.Crf(r.normal(size=html_blocks.SLOTS), r.normal(size=(2, 2)), r.normal(size=2))
    e = r.normal(size=(1, 4))
    label = np.array([[1, 0, 1, 1]])
    score = lambda y: crf.start[y[0]] + sum(e[0, i] * y[i] for i in range(4)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:]))
    z = np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=4)])
    value, grad, _, _ = html_extract.likelihood(crf, e, label, np.ones((1, 4), bool))
    assert abs(value - (score(label[0]) - z)) < 1e-9
    p = [sum(np.exp(score(y) - z) for y in itertools.product((0, 1), repeat=4) if y[i]) for i in range(4)]
    assert np.allclose(grad[0], label[0] - p)
    features = [(1, 2), (3,), (4, 5, 6), (7,)]
    emission = [sum(crf.weights[f] for f in x) for x in features]
    best = max(itertools.product((0, 1), repeat=4), key=lambda y: crf.start[y[0]] + sum(emission[i] * y[i] for i in range(4)) + sum(crf.moves[a, b] for a, b in zip(y, y[1:])))
    assert crf.decode(features) == list(best)


def test_crf_on_held_out_pages(crf):
    right = total = 0
    for features, labels in html_training.training_pages(250, seed=77):
        got = crf.decode(features)
        right += sum(a == b for a, b in zip(got, labels))
        total += len(labels)
    assert right / total > 0.97


def test_extraction_of_odd_pages(spark, crf):
    page = """<html><head><title>T</title><style>p{}</style><script>var a="</p><p>x";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
    <!-- <p>no</p> --><div class="ad">Buy this now.</div><article><h1>The  title &amp; more</h1><p>First   paragraph with words, and <b>bold</b> ones.<p>Second one&nbsp;here, it is also long enough to read.</article>
    <div class="comments"><p>I think this is wrong.</p></div><footer>&copy; Site</footer></body>"""
    rows = [(1, "u", page), (2, "u", None), (3, "u", ""), (4, None, "<nav><a href='/x'>Menu</a></nav>"), (1, "u", page), (6, "u", "<article>" + "<p>Some words of a very long page, again and again.</p>" * 20_000 + "</article>"), (7, "u", "<<<p a='\"<b>")]
    out = html_extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")), crf).collect()
    got = {r["page_id"]: r for r in out}
    assert len(out) == len(rows)
    assert got[1]["text"] == "The title & more\n\nFirst paragraph with words, and bold ones.\n\nSecond one here, it is also long enough to read."
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert [got[i]["text"] for i in (2, 3, 4)] == ["", "", ""] and got[3]["n_chars"] == 0
    assert got[6]["text"].count("\n\n") == 19_999
    assert html_extract.extracted(spark.createDataFrame([], "page_id long, url string, html string"), crf).count() == 0
