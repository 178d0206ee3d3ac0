"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import hashlib
import textwrap

import pytest
from llm_helpers import docs_of

from latentlake.llm import decontam, jaccard, licences, mixing, quality, suffixes, surrogates, tokens, warc, winnowing
from latentlake.llm.common import scratch_path

LONG = "lorem ipsum dolor sit amet " * 4000
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b c d"), (4, LONG), (5, LONG), (5, LONG), (6, "é" * 3000), (7, "one two"), (7, "other text here")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return docs_of(spark, [(1, "x")]).where("doc_id > 5")


def test_suffixes(odd, none):
    got = [tuple(r) for r in suffixes.remove_repeats(odd).collect()]
    assert len(got) == len(ODD)
    by = {(r[0], r[1]): r for r in got}
    long = len(LONG.encode())
    assert by[(4, long)][2:] == (long, 1, hashlib.sha256(b"").hexdigest())
    assert by[(6, 6000)][2:4] == (6000, 1)
    assert by[(1, 0)][2:] == (0, 0, hashlib.sha256(b"").hexdigest())
    assert by[(7, 7)][2:] == (0, 0, hashlib.sha256(b"one two").hexdigest())
    assert suffixes.remove_repeats(none).count() == 0
    kept = {(r["doc_id"], r["n_bytes"]): r["kept"] for r in suffixes.remove_repeats(odd, with_text=True).collect()}
    assert kept[(7, 7)] == b"one two" and kept[(4, long)] == b"" and kept[(2, 0)] == b""


def test_mixing(odd, none):
    got = mixing.mix_plan(odd).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r["copies"] <= 2 and (r["size"] or not r["copies"]) for r in got)
    assert mixing.mix_plan(none).count() == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mixed_documents(none).count() == 0


def test_winnowing(odd, none):
    got = winnowing.edited_pairs(odd).collect()
    assert len(got) == len(ODD)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert {r["fingerprint"] for r in got if r["n_chars"] == len(LONG)}.__len__() == 1
    assert winnowing.edited_pairs(none).count() == 0
    one = winnowing.edited_pairs(odd.where("doc_id = 4")).first()
    assert one["near_next"] == 1.0


def test_quality(spark, odd, none):
    labels = spark.createDataFrame([(1, None, None), (4, 1, 0), (99, 0, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_scores(odd, labels).count() == len(ODD)
    assert quality.quality_scores(odd).count() == len(ODD)
    assert quality.quality_scores(none, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns


def test_warc(spark):
    big, small = "b" * 1000, "b" * 999
    rows = [(1, "http://a", big), (2, None, big), (3, "http://c d\n", big), (4, "u", small), (5, "u", small), (6, "u", None), (None, "n", "x\r\n\r\ny\n"), (3, "http://c d\n", big), (7, "u", "é" * 500)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, payload string, same long")
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    captures = warc.assemble(warc.read_records(spark, path))
    got = sorted(map(tuple, warc.page_records(captures).drop("uri").collect()), key=str)
    sha = lambda x: hashlib.sha1((x or "").encode()).hexdigest()
    want = [(1, 1000, sha(big), "revisit", 3), (2, 1000, sha(big), "revisit", 3), (3, 1000, sha(big), "response", None), (3, 1000, sha(big), "revisit", 3), (4, 999, sha(small), "response", None),
            (5, 999, sha(small), "response", None), (6, 0, sha(""), "response", None), (None, 7, sha("x\r\n\r\ny\n"), "response", None), (7, 1000, sha("é" * 500), "response", None)]
    assert got == sorted(want, key=str)
    assert all(r["request"] is not None and r["metadata"]["payload-bytes"] for r in captures.collect())
    payloads = {bytes(r["payload"]) for r in warc.read_records(spark, path, with_payload=True).where("type = 'response'").collect()}
    assert payloads == {(r[2] or "").encode() for r in rows}
    empty = scratch_path(spark, "warc-test")
    warc.write_archives(pages.where("page_id > 100"), empty)
    assert warc.page_records(warc.assemble(warc.read_records(spark, empty))).count() == 0


def test_licences(spark, odd, none):
    assert licences.licence_matches(odd).count() == 0
    assert licences.licence_matches(none).count() == 0
    mit = "\n".join(licences.NOTICES["MIT"])
    texts = [(1, "Text.\nReleased under the MIT License."), (1, "Text.\nReleased under the MIT License."), (2, f"Intro\n{mit}\nend"), (3, "\n".join(reversed(licences.NOTICES["MIT"]))),
             (None, "licensed***under cc by-nc 4.0"), (4, "Licensed under CC BY-NC 4.0!! More."), (5, licences.NOTICES["MIT"][0] + "\n" + "filler\n" * 9 + "\n".join(licences.NOTICES["MIT"][1:]))]
    got = sorted(((r[0], r[1], r[3], r[4]) for r in licences.licence_matches(docs_of(spark, texts)).collect()), key=str)
    assert got == sorted([(1, "MIT", 1, 1), (2, "MIT", 1, 4), (None, "CC-BY-NC-4.0", 0, 0), (4, "CC-BY-NC-4.0", 0, 0)], key=str)


@pytest.mark.parametrize("width", [24, 72])
@pytest.mark.parametrize("prefix", ["", " * ", "# ", "// "])
def test_wrapped_licences(spark, width, prefix):
    wrap = lambda paragraphs: "Copyright 2020 A. Person\n" + f"\n{prefix}\n".join("\n".join(prefix + x for x in textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False)) for p in paragraphs) + "\nint main() {}"
    n = {**licences.NOTICES, **licences.MORE_NOTICES}
    mit, apache, gpl, bsd = n["MIT"], n["Apache-2.0"], n["GPL-3.0-or-later"], n["BSD-3-Clause"]
    clauses = [f"{i}. {x}" for i, x in enumerate(bsd[1:], 1)]
    cases = {
        "MIT": [mit[0], mit[1], f"{mit[2]} {mit[3]}"], "ISC": n["ISC"], "GPL-3.0-or-later": [" ".join(gpl[:2]), " ".join(gpl[2:])],
        "Apache-2.0": [" ".join(apache[:3]), "http://www.apache.org/licenses/LICENSE-2.0", " ".join(apache[3:])], "BSD-2-Clause": [bsd[0], *clauses[:2]], "BSD-3-Clause": [bsd[0], *clauses],
    }
    texts = [(i, wrap(p)) for i, p in enumerate(cases.values())] + [(10, f"{prefix}Released under the\n{prefix}MIT License."), (11, f"{prefix}Released under the. MIT License."), (12, f"{prefix}Released under the\n{prefix}MIT Licenses.")]
    got = sorted((r["doc_id"], r["licence"]) for r in licences.licence_matches(docs_of(spark, texts)).collect())
    assert got == [*enumerate(cases), (10, "MIT")]


def test_surrogates(odd, none):
    got = surrogates.pseudonymised(odd).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted(ODD, key=str)
    assert surrogates.pseudonymised(none).count() == 0


def test_tokens(spark, odd, none):
    root = tokens.shared_uri(scratch_path(spark, "shards-test"))
    got = tokens.ordered_sequences(odd, root, length=64, rows=16).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got)))
    assert sum(r["docs"] for r in got) == len(ODD)
    assert tokens.ordered_sequences(none, tokens.shared_uri(scratch_path(spark, "shards-test"))).count() == 0


def test_passes_over_different_batches(spark, monkeypatch):
    """The second pass may cut its input into other batches than the first."""
    monkeypatch.setattr(tokens, "BATCH_BYTES", 64 * 2 * 7)
    docs = docs_of(spark, [(i, f"text number {i} " * (i % 5)) for i in range(300)])
    root = tokens.shared_uri(scratch_path(spark, "shards-test"))
    got = tokens.ordered_sequences(docs, root, length=64, rows=16).collect()
    assert sorted(r["slot"] for r in got) == list(range(len(got))) and sum(r["docs"] for r in got) == 300


def test_jaccard(odd, none):
    got = sorted(map(tuple, jaccard.shingle_groups(odd).collect()), key=str)
    assert len(got) == len(ODD)
    groups = {(r[0], r[1]): r[2] for r in got}
    assert groups[(5, 5)] == 4 and groups[(4, 5)] == 4 and groups[(1, 0)] == 1 and groups[(2, 0)] == 2 and groups[(None, 1)] is None
    assert jaccard.shingle_groups(none).count() == 0
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.keep_one(odd).collect()), key=str)
    assert kept == sorted({x for x in ODD if x[0] != 5}, key=str)


def test_decontam(spark, odd, none):
    bench = spark.createDataFrame([(1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet", 0), (2, None, 0), (3, "", 0), (3, "one two", 0)], "item_id long, text string, item long")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(odd, bench).collect()}
    assert got == {(4, 1), (5, 1), (7, 3)}
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.contaminated(odd, bench.where("item_id > 9")).count() == 0
    left = decontam.drop_contaminated(odd, bench)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=str) == sorted((x for x in ODD if x[0] not in (4, 5) and x != (7, "one two")), key=str)
