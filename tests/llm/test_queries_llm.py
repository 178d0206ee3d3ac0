"""Every query of the subpackage against SQL or brute force, on whole tables of the smallest scale."""

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from llm_helpers import SF, docs_of

import corpus_pipeline
from latentlake.llm import decontam, jaccard, mixing, quality, suffixes, surrogates, tokens, winnowing
from latentlake.llm.common import read, scratch_path
from latentlake.llm.queries import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TABLES = ("documents", "labels", "benchmark", "pages")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(tuple, df.select(*names).collect())) == Counter(result.fetchall())


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def removed(texts, length):
    counts = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    for b in texts:
        flags = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                flags[i] += 1
                flags[i + length] -= 1
        yield np.cumsum(flags)[:-1] > 0


def digest(b, gone):
    kept = bytes(np.frombuffer(b, np.uint8)[~gone])
    spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) > 0).sum())
    return len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()


def test_op1(spark, documents):
    raw = [(t or "").encode() for _, t, _ in documents]
    want = {d: digest(b, g) for (d, _, _), b, g in zip(documents, raw, removed(raw, 400), strict=True)}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()}
    assert got == want


def test_hot_seeds_are_cut(spark, monkeypatch):
    """One passage in many texts goes through every width."""
    monkeypatch.setattr(suffixes, "HOT_PIECES", 4)
    rng = np.random.default_rng(5)
    words = lambda n: " ".join("".join(map(chr, rng.integers(97, 123, 5))) for _ in range(n))
    passage, shorter = words(75), words(62)
    texts = [f"{words(30)} {passage if i % 2 else shorter} {words(30)}" for i in range(24)] + ["ab" * 900, passage + passage, words(80)]
    raw = [t.encode() for t in texts]
    want = {i: digest(b, g) for i, (b, g) in enumerate(zip(raw, removed(raw, 400), strict=True))}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffixes.remove_repeats(docs_of(spark, list(enumerate(texts)))).collect()}
    assert got == want


def test_shared_starts():
    rng = np.random.default_rng(1)
    for trial in range(60):
        length, kinds = int(rng.choice([5, 9, 33])), int(rng.choice([1, 2, 8, 256]))
        pieces = [rng.integers(0, kinds, int(rng.integers(1, 120)), dtype=np.uint8).tobytes() for _ in range(int(rng.integers(1, 5)))]
        pieces.append(pieces[0][3:] + pieces[-1][:40])
        pieces = [p or b"x" for p in pieces]
        counts = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        want = [[i for i in range(len(p) - length + 1) if counts[p[i : i + length]] > 1] for p in pieces]
        assert [x.tolist() for x in suffixes.shared_starts(pieces, length)] == want, trial


def test_op2(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op2_mix_sources"](spark, SF).collect()}
    again = {r["doc_id"]: r for r in QUERIES["op2_mix_sources"](spark, SF).collect()}
    assert got == again
    sizes = {d: len(WORD.findall(t or "")) for d, t, _ in documents}
    total, of = sum(sizes.values()), Counter()
    for d, _, s in documents:
        of[s] += sizes[d]
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(sorted(of))}
    target, left, free = {}, 1.5 * total, set(of)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * of[s]}
        if not over:
            target |= share
            break
        target |= {s: 2.0 * of[s] for s in over}
        left -= sum(2.0 * of[s] for s in over)
        free -= over
    taken = Counter()
    for d, _, s in documents:
        r = got[d]
        assert (r["size"], r["source_size"]) == (sizes[d], of[s])
        assert math.isclose(r["target"], target[s], rel_tol=1e-9)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
    for s in of:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 20


def test_entropy_balancing_rates(spark, documents):
    """Rates meet the targets before rounding, and log odds are linear in size within a source."""
    plan = mixing.mix_plan(read(spark, SF, "documents")).toPandas()
    for _, g in plan[plan["size"] > 0].groupby("source"):
        if g["target"].iloc[0] < 2 * g["source_size"].iloc[0] - 1:
            assert math.isclose((g["rate"] * g["size"]).sum(), g["target"].iloc[0], rel_tol=1e-6)
            inner = g[(g["rate"] > 1e-6) & (g["rate"] < 2 - 1e-6)]
            slope = np.log(inner["rate"] / (2 - inner["rate"])) / inner["size"]
            assert slope.max() - slope.min() < 1e-6 * max(1e-3, abs(slope).max()) + 1e-9


def winnowed(text, k=winnowing.K, w=winnowing.W):
    return [int(x[:12], 16) for x in re.findall(".{20}", winnowing.encoded(*winnowing.winnow(winnowing.code_points(text), k, w)))]


def test_op3(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op3_winnowing"](spark, SF).collect()}
    for i, (d, t, _) in enumerate(documents):
        t, after = t or "", documents[(i + 1) % len(documents)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        a, b, c = set(winnowed(t)), set(winnowed(edited)), set(winnowed(after))
        assert math.isclose(r["near_edited"], len(a & b) / len(a | b)) and math.isclose(r["near_next"], len(a & c) / len(a | c))
        assert r["edited_fingerprint"] == winnowing.encoded(*winnowing.winnow(winnowing.code_points(edited)))


def test_short_edited_texts_are_nearer_than_others(spark):
    rng = np.random.default_rng(5)
    docs = [(n, "".join(map(chr, rng.integers(97, 123, n)))) for n in range(40, 251)]
    for r in winnowing.edited_pairs(docs_of(spark, docs)).collect():
        assert r["near_edited"] > r["near_next"], r["n_chars"]


def test_winnowing_rule():
    """Least hash of each window, rightmost among equals, by the definition; and the match guarantee."""
    rng = np.random.default_rng(2)
    for _ in range(40):
        points = rng.integers(97, 97 + int(rng.choice([1, 2, 20])), int(rng.integers(1, 120))).astype(np.uint32)
        k, w = 4, 5
        _, at = winnowing.winnow(points, k, w)
        if len(points) < k:
            assert at.tolist() == [0]
            continue
        top = winnowing.rolling(points, k) >> np.uint64(32)
        want = []
        for i in range(max(1, len(top) - w + 1)):
            window = top[i : i + w]
            p = i + max(j for j in range(len(window)) if window[j] == window.min())
            want += [p] if not want or want[-1] != p else []
        assert at.tolist() == want
    shared = "".join(map(chr, rng.integers(97, 123, winnowing.K + winnowing.W - 1)))
    assert set(winnowed("x" * 500 + shared + "y" * 300)) & set(winnowed("q" * 77 + shared + "zz" * 90))


@pytest.fixture(scope="module")
def held_out(spark):
    """(kept, clean) of the annotated half that did not train."""
    sf = SF.replace("0.001", "0.01")
    labels = read(spark, sf, "labels")
    keep = {r["doc_id"]: r["keep"] for r in quality.quality_scores(read(spark, sf, "documents"), labels.where("doc_id % 2 = 0")).collect()}
    return [(keep[r["doc_id"]], r["quality"] == 1 and r["toxic"] == 0) for r in labels.where("doc_id % 2 = 1").collect()]


def test_op4_keeps_held_out_clean_documents(held_out):
    assert np.mean([k for k, clean in held_out if clean]) >= 0.97


@pytest.mark.xfail(reason="0.43 of held-out bad documents stay at this scale (200 annotations train), 0.27 at sf0.1; see README", strict=False)
def test_op4_rejects_held_out_bad_documents(held_out):
    assert np.mean([k for k, clean in held_out if not clean]) <= 0.25


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(3)
    y = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.8, 0.7, 0.9])
    votes = np.where(rng.random((len(y), 4)) < right, y[:, None], ~y[:, None]) * 2
    votes[rng.random(votes.shape) < 0.3] = 1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    share, says_good, post = quality.label_model(patterns, counts.astype(float))
    assert abs(share - 0.7) < 0.02 and np.abs(says_good[1] - right).max() < 0.03 and np.abs(1 - says_good[0] - right).max() < 0.04
    assert np.isnan(post[(patterns == 1).all(axis=1)]).all()


def test_op7(spark, documents):
    got = {r["doc_id"]: r for r in QUERIES["op7_surrogates"](spark, SF).collect()}
    real = re.compile(r"[\w.]+@[\w.]+\w|\+\d[\d ()\-]{8,}\d|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b|\b[0-9a-f]{40}\b")
    for d, t, _ in documents:
        found = real.findall(t or "")
        assert got[d]["n_entities"] == len(found)
        assert not any(x in (got[d]["text"] or "") for x in found)
        assert found or got[d]["text"] == t


FORMS = (
    "(743) 555-3824", "743-555-3824", "030 1234567", "06 12 34 56 78", "+33 6 12 34 56 78", "+34 612 34 56 78", "3782 822463 10005", "378282246310005",
    "2001:0db8:85a3:0000:0000:8a2e:0370:7334", "fe80::1ff:fe23:4567:890a", "张伟@例子.com", "محمد@مثال.org", "արամ@Օրինակ.am", "1@2.com", "שלום@example.org",
)


def test_more_surrogate_forms(spark):
    """Every form goes, keeps its shape, and is told apart; an address in any script finds a surrogate."""
    got = {r["doc_id"]: r for r in surrogates.pseudonymised(docs_of(spark, [(i, f"Write to {x}, please. Or {x}") for i, x in enumerate(FORMS)])).collect()}
    seen = set()
    for i, form in enumerate(FORMS):
        assert got[i]["n_entities"] == 2, form
        shown = re.fullmatch("Write to (.*), please. Or (.*)", got[i]["text"])
        assert shown[1] == shown[2] != form and shown[1] not in FORMS
        shape = lambda t: re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", t)) if "@" not in t and ":" not in t else re.sub(r"[^@.:]+", "x", t)
        assert shape(shown[1]) == shape(form)
        seen.add(shown[1])
    assert len(seen) == len(FORMS)
    digits = [re.sub(r"\D", "", got[i]["text"]) for i in range(len(FORMS))]
    assert digits[0] == digits[1] and digits[6] == digits[7]
    kept = "Not 2024-01-01, 12:30:45, v1.2.3, 10 000 000, a::b, 007, 100-200, nor 1234567."
    assert surrogates.pseudonymised(docs_of(spark, [(1, kept)])).first()["text"] == kept


def test_crowded_surrogates(spark):
    """Addresses that fill all of their own length get longer ones."""
    texts = [(i, f"mail {i}@7.com now") for i in range(10)]
    got = [r["text"] for r in surrogates.pseudonymised(docs_of(spark, texts)).collect()]
    assert len(set(got)) == 10 and not set(got) & {t for _, t in texts}


def test_surrogate_forms(spark):
    text = (
        "Mr. John Smith and Mrs Smith, Dr. Иван Петров; Mr John Smith again; a.b-1@Mail.example.com, A.B-1@mail.example.com, c@mail.example.com "
        "+1 (017) 555-7713 +1 017 555 7713 4539 1488 0343 6467 4539148803436467 10.0.0.1 078-05-1120 DE89 3704 0044 0532 0130 00 "
        "ABCDEF0123456789abcdef0123456789 v1.2.3 2024-01-01"
    )
    got = surrogates.pseudonymised(docs_of(spark, [(1, text), (2, "Frau Smith wrote to c@mail.example.com"), (1, text)])).collect()
    assert len(got) == 3
    one = next(r["text"] for r in got if r["doc_id"] == 1)
    two = next(r["text"] for r in got if r["doc_id"] == 2)
    shape = lambda t: re.sub(r"[A-ZА-Я]", "A", re.sub(r"[a-zа-я]", "a", re.sub(r"\d", "0", t)))
    m = re.match(r"Mr\. (\w+) (\w+) and Mrs (\w+), Dr\. (\w+) (\w+); Mr (\w+) (\w+) again; (\S+), (\S+), (\S+) (\+1 \(\d{3}\) \d{3}-\d{4}) (\+1 \d{3} \d{3} \d{4}) (\d{4} \d{4} \d{4} \d{4}) (\d{16}) (\d+\.\d+\.\d+\.\d+) (\d{3}-\d{2}-\d{4}) (DE[0-9 ]+) ([A-Fa-f0-9]{32}) v1.2.3 2024-01-01$", one)
    assert m, one
    assert m[2] == m[3] == m[7] and m[1] == m[6] and m[1] not in ("John",) and m[2] != "Smith" and m[2] in two and two.startswith("Frau ")
    assert m[1] in surrogates.GIVEN["m"]
    assert shape(m[4]) == "Aaaa" and re.fullmatch("[А-Яа-я]+", m[4]) and re.fullmatch("[А-Яа-я]+", m[5])
    assert m[8].lower() == m[9].lower() and shape(m[8]) == shape("a.b-1@Mail.example.com") and m[10] in two and m[10].split("@")[1] == m[9].split("@")[1]
    digits = lambda t: re.sub(r"\D", "", t)
    assert digits(m[11]) == digits(m[12]) and digits(m[13]) == m[14] != "4539148803436467"
    luhn = lambda s: sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10
    assert luhn(m[14]) == 0


def test_surrogates_stay_distinct(spark):
    """Ten thousand short codes, most of the free space: every one gets another, none of them a real one."""
    units = spark.range(700).selectExpr("'ssn' AS kind", "lpad(cast(id AS string), 4, '0') AS canon")
    got = surrogates.distinct_surrogates(units).collect()
    assert len(got) == 700 == len({r["surrogate"] for r in got}) and not {r["surrogate"] for r in got} & {f"{i:04d}" for i in range(700)}


def test_op8(spark, documents):
    root = tokens.shared_uri(scratch_path(spark, "shards-test"))
    length, rows = 128, 64
    got = sorted(map(tuple, tokens.ordered_sequences(read(spark, SF, "documents"), root, length=length, rows=rows, key=9).select("slot", "sha256", "used", "docs").collect()))
    core = tokens.encoder(tokens.VOCABULARY).core
    n = len(got)
    assert [g[0] for g in got] == list(range(n))
    back = tokens.Feistel(n, 9).backward(np.arange(n))
    read_back = tokens.read_from(root, 0, n, length, rows)
    assert read_back.shape == (n, length)
    assert [hashlib.sha256(x.tobytes()).hexdigest() for x in read_back] == [g[1] for g in got]
    assert (tokens.read_from(root, 70, 5, length, rows) == read_back[70:75]).all()
    stream, used = read_back[np.argsort(back)], np.array([g[2] for g in got])[np.argsort(back)]
    ids = np.concatenate([x[:u] for x, u in zip(stream, used, strict=True)]).tolist()
    texts, at = [], 0
    for i, x in enumerate(ids):
        if x == tokens.SEPARATOR:
            texts.append(core.decode(ids[at:i]))
            at = i + 1
    assert sorted(texts) == sorted(t or "" for _, t, _ in documents) and sum(g[3] for g in got) == len(documents)


def test_encoder_equals_the_public_one():
    e = tokens.encoder(tokens.VOCABULARY)
    rng = np.random.default_rng(4)
    letters = [*" \n\t\r\x0b\x0c  ab1é中²Ⅷ.,!-_", "'s", "'", "'ll", "\x85", " ", "\U0001f600", "  "]
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 16)))) for _ in range(3000)]
    ids, counts = e.encode(texts)
    ends = np.cumsum(counts)
    assert [ids[a - c : a].tolist() for a, c in zip(ends, counts, strict=True)] == [e.core.encode_ordinary(t) for t in texts]


def test_feistel():
    for n in (1, 2, 3, 17, 1000):
        f = tokens.Feistel(n, 5)
        x = f.forward(np.arange(n))
        assert sorted(x.tolist()) == list(range(n)) and (f.backward(x) == np.arange(n)).all()


def components_of(texts, k, num, den):
    sets = {}
    for d, t in texts:
        w = WORD.findall(lower(t or ""))
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def test_op9(spark, documents):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op9_shingle_jaccard"](spark, SF).collect()}
    assert got == components_of([(d, t) for d, t, _ in documents], 3, 90, 100)


def test_large_near_copy_groups(spark, monkeypatch):
    """Cells that are cut into chunks, several rounds, chains of links."""
    monkeypatch.setattr(jaccard, "CELL", 8)
    monkeypatch.setattr(jaccard, "OFFERS", (1, 2, 4, None))
    monkeypatch.setattr(jaccard, "HELD", 10)
    rng = np.random.default_rng(6)
    word = lambda: "".join(map(chr, rng.integers(97, 123, 6)))
    texts = []
    for _ in range(3):
        base = [word() for _ in range(60)]
        for _ in range(25):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(0, 60))] = word()
            texts.append(" ".join(copy))
            if rng.random() < 0.3:
                base = copy
    rows = list(enumerate(texts))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.shingle_groups(docs_of(spark, rows), 3, 90, 100).collect()}
    assert got == components_of(rows, 3, 90, 100)


def test_links_through_null_ids(spark):
    words = [f"w{i}" for i in range(200)]
    edit = lambda *at: " ".join(w if i not in at else f"x{i}" for i, w in enumerate(words))
    rows = [(1, edit()), (None, edit(50, 51, 52)), (3, edit(50, 51, 52, 120, 121, 122)), (4, "something else altogether here"), (None, "a text of its own again")]
    pairs = components_of([(i, t) for i, (_, t) in enumerate(rows)], 3, 90, 100)
    assert [c for _, c in pairs.values()] == [0, 0, 0, 3, 4]
    got = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.shingle_groups(docs_of(spark, rows), 3, 90, 100).collect()), key=str)
    assert got == sorted([(1, 1), (None, 1), (3, 1), (4, 4), (None, None)], key=str)
    kept = jaccard.keep_one(docs_of(spark, rows), 3, 90, 100).collect()
    assert sorted((r["text"] for r in kept)) == sorted(rows[i][1] for i in (0, 3, 4))


def test_one_id_with_two_texts(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [(1, base), (5, base + " more"), (5, "quite another clean text of that doc_id"), (None, base), (7, None), (7, None), (9, "twice the same row"), (9, "twice the same row")]
    got = jaccard.keep_one(docs_of(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=str)
    assert [c for c in got[0].asDict()] == docs_of(spark, rows).columns


def test_wide_and_narrow_bitmaps():
    """The bound is never below the overlap, at any ratio of sizes."""
    rng = np.random.default_rng(8)
    sets = [jaccard.distinct(rng.integers(0, 3000, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for n in (1, 30, 120, 400, 900, 1500, 2500)]
    size = np.array([len(s) for s in sets])
    maps = jaccard.Bitmaps([jaccard.bitmap(s) for s in sets], size, 100.0)
    x, y = (i.ravel() for i in np.indices((len(sets), len(sets))))
    true = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in zip(x, y, strict=True)])
    most = maps.overlap(x, y)
    assert (most >= true).all() and (most <= np.minimum(size[x], size[y])).all()


def test_op10(spark, duck, documents):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    rng = np.random.default_rng(7)
    edited = []
    for i, (item, t) in enumerate(items[:20]):
        w = t.split()
        for _ in range(len(w) // 8):
            w[int(rng.integers(0, len(w)))] = "changed"
        edited.append((10_000 + i, "Some words before it. " + " ".join(w) + " and some after it.", item))
    docs = docs_of(spark, [(d, t) for d, t, _ in documents] + [(d, t) for d, t, _ in edited])
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.contaminated(docs, read(spark, SF, "benchmark")).collect()}
    exact = {(d, i) for d, t, _ in documents for i, x in items if x in (t or "")}
    assert exact | {(d, i) for d, _, i in edited} <= set(got)
    plain = lambda t: [x for x in (re.sub(r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", "", w) for w in WORD.findall(lower(t or ""))) if x]
    text = {d: t for d, t, _ in documents} | {d: t for d, t, _ in edited}
    words = dict(items)

    def local(a, b):
        last, best = [0] * (len(b) + 1), 0
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(0, last[j] + (1 if x == y else -1), last[j + 1] - 1, row[j] - 1))
            best, last = max(best, *row), row
        return best

    for (d, i), r in got.items():
        assert r["score"] == local(plain(words[i]), plain(text[d])) and r["item_words"] == len(plain(words[i]))
        found = plain(text[d])[r["first_word"] : r["last_word"] + 1]
        assert local(plain(words[i]), found) == r["score"]


def test_items_that_many_documents_hold(spark):
    item = [f"item{j}" for j in range(24)]
    edits = {i: [w if j not in (5, 9, 13, 17, 21) else f"edit{i}x{j}" for j, w in enumerate(item)] for i in range(40)}
    docs = docs_of(spark, [(i, f"before{i} " + " ".join(w) + f" after{i}") for i, w in edits.items()] + [(100 + i, f"text{i} says one two three four five here{i}") for i in range(40)])
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "one two three four five"), (3, "one two three")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["score"], r["first_word"], r["last_word"]) for r in decontam.contaminated(docs, bench).collect()}
    want = {(i, 1): (14, 1, 24) for i in range(40)} | {(100 + i, 2): (5, 2, 6) for i in range(40)} | {(100 + i, 3): (3, 2, 4) for i in range(40)}
    assert got == want
    assert decontam.drop_contaminated(docs, bench).count() == 0


def test_pipeline(spark, documents):
    docs = read(spark, SF, "documents")
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.settle(stage(spark, docs, SF))
        if i < 4:
            assert out.columns == columns
        kept.append(out)
        docs = out
    ids = [[r["doc_id"] for r in k.select("doc_id").collect()] for k in kept[:4]]
    text = {d: t for d, t, _ in documents}
    groups = components_of([(d, text[d]) for d in ids[0]], 5, 80, 100)
    assert sorted(ids[1]) == sorted({c for _, c in groups.values()})
    bench = read(spark, SF, "benchmark")
    bad = {r["doc_id"] for r in decontam.contaminated(kept[1], bench).collect()}
    assert bad and sorted(ids[2]) == sorted(set(ids[1]) - bad)
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(kept[2]).collect()}
    assert Counter(ids[3]) == Counter({d: c for d, c in plan.items() if c})
    rows = kept[4].collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and sum(r["docs"] for r in rows) == len(ids[3])
