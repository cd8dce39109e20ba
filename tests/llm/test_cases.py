"""Nulls, empty and odd texts, ties, repeated rows, empty tables, and clashing columns."""

import hashlib
import re

import pytest

pytest.importorskip("skarn.llm")

from pyspark.sql import functions as F  # noqa: E402

from skarn.llm import chat, exact, neardup, packing, pieces, quality, ranker, substring, urlfilter, warc  # noqa: E402
from skarn.llm.scratch import Scratch  # noqa: E402

LONG = " ".join(f"word{i}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, pos int, n long, name string, host string, node long, at string, row int, spans int, __x int"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with every oddity, and columns whose names operators use themselves."""
    texts = [(1, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (3, None), (4, ""), (None, "a b c d e"), (5, " \n\t "), (6, LONG), (7, LONG), (8, "one"), (9, "One"), (None, None), (10, f"x {PASSAGE} y"), (11, f"{PASSAGE} z"), (10, "other text of one id")]
    return spark.createDataFrame([(i, t, "en", None if i == 8 else "s", len(t or ""), "k", 1, 2, "nm", "h", 3, "a", 4, 5, 6) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_classes(spark, odd):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.classes(spark, odd, 64).collect()), key=str)
    want = [(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 4, 3, False), (4, 4, 3, True), (None, 2, 4, False), (5, 5, 1, True), (6, 7, 2, False), (7, 7, 2, True), (8, 8, 1, True), (9, 9, 1, True), (None, 4, 3, False), (10, 10, 1, True), (11, 11, 1, True), (10, 10, 1, True)]
    assert got == sorted(want, key=str)


def test_exact_names_never_rest_on_hashes(spark, odd):
    plain = sorted(map(str, exact.classes(spark, odd, 64).collect()))
    assert sorted(map(str, exact.classes(spark, odd, 64, lambda b: F.xxhash64(b) % 3).collect())) == plain


def test_exact_keep(spark, odd, none):
    got = exact.keep(spark, odd)
    assert got.columns == odd.columns
    assert sorted((r["doc_id"], (r["text"] or "")[:5]) for r in got.collect()) == [(2, "a b c"), (4, ""), (5, " \n\t "), (7, "word0"), (8, "one"), (9, "One"), (10, "other"), (10, "x p0 "), (11, "p0 p1")]
    assert exact.keep(spark, none).count() == 0 and exact.classes(spark, none).count() == 0


def test_near_duplicate_cases(spark, odd, none):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(spark, odd, 3, 85, 100).collect()), key=str)
    n = len(LONG.split()) - 2
    want = [(1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), (None, 3, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (None, 0, None, True), (6, n, 6, True), (7, n, 6, False), (8, 1, 8, True), (9, 1, 8, False), (10, 60, 10, True), (10, 3, 10, True), (11, 59, 10, False)]
    assert got == sorted(want, key=str)
    assert neardup.classes(spark, none, 3, 85, 100).count() == 0
    kept = neardup.keep(spark, odd)
    assert kept.columns == odd.columns and neardup.keep(spark, none).count() == 0


def test_substring_cases(spark, odd, none):
    got = sorted(((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.removals(spark, odd).collect()), key=str)
    want = [(1, 5, 0), (2, 5, 0), (2, 5, 0), (3, 0, 0), (4, 0, 0), (None, 5, 0), (5, 0, 0), (6, 30_000, 0), (7, 30_000, 30_000), (8, 1, 0), (9, 1, 0), (None, 0, 0), (10, 62, 0), (11, 61, 60), (10, 5, 0)]
    assert got == sorted(want, key=str)
    clean = substring.clean(spark, odd)
    assert clean.columns == odd.columns and substring.clean(spark, none).count() == 0 and substring.removals(spark, none).count() == 0
    new = {r["doc_id"]: r for r in clean.where("doc_id > 10").collect()}
    assert new[11]["text"] == "z" and new[11]["n_chars"] == 1


def test_substring_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    parts = [[f"t{rng.randrange(400)}" for _ in range(rng.choice([20, 55, 70, 130]))] for _ in range(12)]
    rows = [(i, " ".join(w for p in rng.sample(range(12), rng.randint(1, 4)) for w in parts[p])) for i in range(60)] + [(60 + i, "same line here\n" * 40) for i in range(5)]
    first: dict = {}
    for i, t in rows:
        w = t.split()
        for j in range(len(w) - 49):
            first.setdefault(tuple(w[j : j + 50]), i)
    want = {}
    for i, t in rows:
        w = t.split()
        gone = {x for j in range(len(w) - 49) if first[tuple(w[j : j + 50])] < i for x in range(j, j + 50)}
        want[i] = (len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    got = substring.removals(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in got} == want


def test_quality_cases(spark, odd, none):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.judge(spark, odd).collect()}
    assert got[8, 1]["host_failed"] is False and got[8, 1]["base_failed"] is True
    assert got[6, 30_000]["base_failed"] is False and got[6, 30_000]["kept"] == (not got[6, 30_000]["host_failed"])
    assert got[3, 0]["n_dup_lines"] == 0 and quality.judge(spark, none).count() == 0
    kept = quality.keep(spark, odd)
    assert kept.columns == odd.columns and quality.keep(spark, none).count() == 0


def test_quality_counts_equal_brute_force(spark):
    texts = ["a b c a b c", "x y z", "a a a a a", "l1 w\nl1 w\n\n \nl2\nl2", "one two", "# $ %%\v& <>", "é é é b é é é b", "p q r s p q r t p q r"]
    got = quality.measure(spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")).collect()
    for r in got:
        t = texts[r["doc_id"]]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len({i + j for i, g in enumerate(runs) if runs.count(g) > 1 for j in range(3)}))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, t


def test_a_bad_host_takes_its_documents_with_it(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "too short"
    rows = [(i, bad if i else good, "spam.example") for i in range(60)] + [(100 + i, bad if i == 0 else good, f"h{i % 5}.example") for i in range(60)]
    got = {r["doc_id"]: r for r in quality.judge(spark, spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not got[0]["base_failed"] and got[0]["host_failed"] and not got[0]["kept"]
    assert got[101]["kept"] and not got[100]["kept"] and not got[100]["host_failed"]


def test_packing_cases(spark, odd, none):
    got = packing.pack(spark, odd, packing.default_tokenizer(), with_ids=True).collect()
    assert sum(r["length"] for r in got if r["doc_id"] in (3, 4, 5)) == 3
    assert sum(r["length"] for r in got if r["doc_id"] == 6) == [r["doc_tokens"] for r in got if r["doc_id"] == 6][0]
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack(spark, none, packing.default_tokenizer()).count() == 0
    assert packing.powers_of_two(0) == [] and packing.powers_of_two(4095) == [1 << i for i in range(11, -1, -1)]


def test_the_open_windows_are_bounded():
    import numpy as np

    sealed: list = []
    packer = packing.Packer(100, 4, 10, sealed.append)
    rng = np.random.default_rng(2)
    for i in range(500):
        packer.add(i, 0, np.arange(rng.integers(1, 250)), 0)
        assert len(packer.held) <= 4
    sizes = [sum(len(p[2]) for p in s) for s in sealed]
    assert max(sizes) <= 100 and min(sizes) > 90


def test_pieces_cases(spark, odd, none):
    own = pieces.default_model()
    got = pieces.decode(spark, pieces.encode(spark, odd, own), own).collect()
    assert sorted(r["text"][:6] for r in got) == sorted((r["text"] or "")[:6] for r in odd.collect())
    assert pieces.encode(spark, none, own).count() == 0


def test_ranker_cases(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (6, 1), (8, 0), (9, 0), (9, 1), (11, 0), (None, 0), (7, None)], "doc_id long, quality int")
    got = ranker.score(spark, odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    assert ranker.score(spark, none, labels).count() == 0


def test_chat_round_trip(spark):
    said = [(1, 0, "user", "a<|im_end|>\n<\\|b <\\\\|"), (1, 1, "user", None), (1, 2, "assistant", "x<|im_sep|>y"), (1, 3, "assistant", ""), (1, 4, "as\nsis\\ntant<|", "z"), (2, 1, None, "q"), (2, None, "assistant", "r|<|"), (None, 1, "user", "n"), (3, 1, "user", "t"), (3, 1, "user", "t"), (3, 1, "assistant", LONG)]
    df = spark.createDataFrame([(*x, "extra") for x in said], "conv_id long, turn long, role string, text string, turns string")
    out = chat.render(df).select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.learned(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    for r in out:
        own = sorted((x for x in said if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [tuple(t) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in own]
        assert r["learned"] == [x[3] or "" for x in own if x[2] == "assistant"]
    assert chat.render(df.limit(0)).count() == 0


def test_warc_round_trip(spark):
    big = "<p>" + "ä" * 200 + "</p>"
    pages = spark.createDataFrame([(1, "http://a/x y", big, 9), (2, None, big, 9), (3, "http://b/\r\nX: 1", None, 9), (4, "", "s", 9), (5, "u%20", "s", 9), (None, "n", big, 9), (1, "http://a/2", big, 9), (6, "http://c", "\r\n\r\nWARC/1.1\r\n" + big, 9)], "page_id long, url string, html string, first int")
    root = Scratch(spark, "warc-test").root
    index = warc.write(spark, pages, root, archive_bytes=300)
    got = warc.read(index, root, gap=0, task_bytes=200).collect()
    key = lambda x: str((x[0], x[1]))
    assert sorted(((r["page_id"], r["url"]) for r in got), key=key) == sorted(((r["page_id"], r["url"]) for r in pages.collect()), key=key)
    by = {(r["page_id"], r["url"]): r for r in got}
    assert by[2, None]["record_type"] == "revisit" and by[2, None]["refers_to"] == 1 and by[2, None]["payload_bytes"] == len(big.encode())
    assert by[1, "http://a/x y"]["record_type"] == by[1, "http://a/2"]["record_type"] == "response"
    assert by[None, "n"]["refers_to"] == 1 and by[5, "u%20"]["record_type"] == "response"
    assert by[1, "http://a/2"]["payload"].decode() == big and by[3, "http://b/\r\nX: 1"]["payload_bytes"] == 0
    one = warc.read(index.where("page_id = 6"), root).collect()
    assert [r["payload"].decode() for r in one] == ["\r\n\r\nWARC/1.1\r\n" + big]
    nothing = Scratch(spark, "warc-none").root
    assert warc.read(warc.write(spark, pages.limit(0), nothing), nothing).count() == 0


def test_ranges_coalesce():
    ranges = [("a", 0, 10), ("a", 10, 5), ("a", 40, 5), ("b", 0, 5), ("b", 5, 100)]
    assert list(warc.coalesced(ranges, 50, 0)) == [("a", 0, 15, [0, 1]), ("a", 40, 45, [2]), ("b", 0, 5, [3]), ("b", 5, 105, [4])]
    assert list(warc.coalesced(ranges, 50, 30)) == [("a", 0, 45, [0, 1, 2]), ("b", 0, 5, [3]), ("b", 5, 105, [4])]


def test_url_filter_in_time(spark):
    entries = spark.sql("""SELECT domain, CAST(listed_at AS DATE) AS listed_at, action, category FROM VALUES ('bad.org', '2024-02-01', 'add', 'x'), ('bad.org', '2024-03-01', 'remove', 'x'), ('Sub.bad.org', '2024-01-01', 'add', 'y'),
      ('tie.org', '2024-01-01', 'add', 'z'), ('tie.org', '2024-01-01', 'remove', 'z'), (NULL, '2024-01-01', 'add', 'q'), ('bad.org', '2024-02-01', 'add', 'x') AS t(domain, listed_at, action, category)""")
    captures = spark.sql("""SELECT page_id, url, CAST(d AS DATE) AS fetched_at, 'c' AS domain FROM VALUES (1, 'http://bad.org/', '2024-01-31'), (2, 'https://u:p@www.BAD.org:80/x', '2024-02-01'), (3, 'http://bad.org', '2024-03-01'), (4, 'http://a.sub.bad.org./', '2024-02-15'),
      (5, NULL, '2024-02-15'), (6, 'nourl', '2024-02-15'), (7, 'http://tie.org', '2024-02-01'), (8, 'http://notbad.org', '2024-02-15'), (9, 'http://bad.org', NULL) AS t(page_id, url, d)""")
    got = {r["page_id"]: (r["blocked"], r["entry_domain"]) for r in urlfilter.judge(spark, captures, entries).collect()}
    assert got == {1: (False, None), 2: (True, "bad.org"), 3: (False, None), 4: (True, "sub.bad.org"), 5: (False, None), 6: (False, None), 7: (False, None), 8: (False, None), 9: (False, None)}
    assert urlfilter.judge(spark, captures.limit(0), entries).count() == 0
    assert not any(r["blocked"] for r in urlfilter.judge(spark, captures, entries.limit(0)).collect())


CLASHES = "__id long, __sha string, __sha2 string, __key long, __at long, __text string, __failed boolean, __host string, `a.b` string, row string, id long, m int, keep_id long, gone_id long, text_key long, name string, base_failed boolean, symbols int, strict_symbols boolean, `with space` int"


@pytest.fixture(scope="module")
def clashing(spark, odd):
    """The odd documents, with columns named like those that operators use."""
    names = [x.strip() for x in CLASHES.split(",")]
    first = odd.select("doc_id", "text", "lang", "source", "n_chars")
    return first.select("*", *[F.lit(None).cast(x.rsplit(" ", 1)[1]).alias(x.rsplit(" ", 1)[0].strip("`")) if i % 2 else F.lit("1").cast(x.rsplit(" ", 1)[1]).alias(x.rsplit(" ", 1)[0].strip("`")) for i, x in enumerate(names)])


@pytest.mark.parametrize("stage", [exact.keep, neardup.keep, quality.keep, substring.clean], ids=["exact", "neardup", "quality", "substring"])
def test_columns_of_any_name_stay(spark, odd, clashing, stage):
    got, plain = stage(spark, clashing), stage(spark, odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert got.columns == clashing.columns
    key = lambda r: (str(r["doc_id"]), r["text"] or "", r["n_chars"])
    assert sorted(map(key, got.collect())) == sorted(map(key, plain.collect()))
    assert {r["a.b"] for r in got.collect()} <= {"1"} | {None}


TWIN = ("".join("xy"[bin(i).count("1") % 2] for i in range(2048)), "".join("yx"[bin(i).count("1") % 2] for i in range(2048)))


def test_words_made_to_collide_are_told_apart(spark):
    """A bit pattern and its complement: equal under any polynomial modulo a power of two."""
    rest = " ".join(f"w{i}" for i in range(50))
    pairs = spark.createDataFrame([(1, f"{TWIN[0]} {rest}"), (2, f"{TWIN[1]} {rest}"), (3, TWIN[0]), (4, TWIN[1]), (5, f"a {TWIN[0]} b c {TWIN[1]}")], "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.removals(spark, pairs).collect()}
    assert got == {1: 0, 2: 50, 3: 0, 4: 0, 5: 0}
    near = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.classes(spark, pairs, 1, 99, 100).collect()}
    assert near == {1: (51, 1), 2: (51, 2), 3: (1, 3), 4: (1, 4), 5: (5, 5)}


def test_shingle_names_stand_for_words():
    import random

    from skarn.llm import wordhash

    rng = random.Random(2)
    texts = [[f"{rng.randrange(30)}".encode() for _ in range(rng.choice([0, 1, 2, 3, 60]))] for _ in range(80)]
    for k in (1, 3, 5, 13):
        sets = [{tuple(t[i : i + k]) for i in range(len(t) - k + 1)} or ({tuple(t)} if t else set()) for t in texts]
        got = wordhash.named(texts, k)
        for i in range(len(texts)):
            assert len(got[i]) == len(sets[i])
            for j in range(i):
                assert len(set(got[i].tolist()) & set(got[j].tolist())) == len(sets[i] & sets[j])


def test_categories_of_a_domain_run_apart(spark):
    entries = spark.sql("""SELECT domain, CAST(t AS TIMESTAMP) AS listed_at, action, category FROM VALUES ('a.org', '2024-01-01', 'add', 'spam'), ('a.org', '2024-02-01', 'add', 'malware'), ('a.org', '2024-03-01', 'remove', 'malware'), ('b.org', '2024-01-01', 'remove', 'x'),
      ('[::1]', '2024-01-01', 'add', 'y'), ('0.0.1', '2024-01-01', 'add', 'z'), ('c.org', '2024-01-01', 'add', NULL) AS t(domain, t, action, category)""")
    long = "http://" + "s." * 2000 + "a.org/" + "p" * 100_000
    rows = [(1, "http://a.org", "2024-04-01"), (2, "http://a.org", "2024-02-15"), (3, "http://b.org", "2024-04-01"), (4, "http://[::1]:80/x", "2024-04-01"), (5, "http://10.0.0.1/", "2024-04-01"), (None, long, "2024-04-01"), (1, "http://a.org", "2024-04-01"), (7, "http://c.org", "2024-04-01")]
    captures = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, t string, domain string").withColumn("fetched_at", F.col("t").cast("timestamp")).withColumn("at", F.lit(1)).withColumn("hit", F.lit(2))
    got = sorted(((r["page_id"], r["blocked"], r["entry_domain"], r["category"]) for r in urlfilter.judge(spark, captures, entries).collect()), key=str)
    want = [(1, True, "a.org", "spam"), (1, True, "a.org", "spam"), (2, True, "a.org", "spam"), (3, False, None, None), (4, True, "[::1]", "y"), (5, False, None, None), (None, True, "a.org", "spam"), (7, True, "c.org", None)]
    assert got == sorted(want, key=str)


def test_warc_urls_and_ids(spark):
    big = "<p>" + "x" * 200 + "</p>"
    urls = ["https://x/a%20b", "https://x/ü?q=a b&c=%2F", "", "a\\0b%", "https://x/%ZZ\r\nEvil: 1", "https://x/plain"]
    for u in urls:
        head = warc.parse_record(warc.record(1, u, b"p", "d", None))[0]
        assert (warc.read_url(head["X-URL"]) if "X-URL" in head else head["WARC-Target-URI"]) == u and "Evil" not in head
    assert warc.escaped_url("https://x/a%20b") == "https://x/a%20b"
    pages = spark.createDataFrame([(1, "u", big), (1, "u", big), (None, "v", big), (None, "w", "s"), (2, "z", big)], "page_id long, url string, html string").withColumn("digest", F.lit("clash")).withColumn("first", F.lit(1)).withColumn("fetched_at", F.lit("2024-05-06 07:08:09").cast("timestamp"))
    scratch = Scratch(spark, "warc-ids")
    index = warc.write(spark, pages, scratch.root)
    raw = [open(f"{scratch.root.removeprefix('file://')}/archives/{r['archive']}", "rb").read()[r["offset"] : r["offset"] + r["length"]] for r in index.collect()]
    import zlib

    heads = [warc.parse_record(zlib.decompress(x, wbits=31))[0] for x in raw]
    assert len({h["WARC-Record-ID"] for h in heads}) == 5 and {h["WARC-Date"] for h in heads} == {"2024-05-06T07:08:09Z"}
    got = warc.resolved(spark, warc.read(index, scratch.root)).collect()
    assert len(got) == 5 and {bytes(r["payload"]).decode() for r in got} == {big, "s"} and all(r["payload_digest"] == hashlib.sha256(bytes(r["payload"])).hexdigest() for r in got)
    assert warc.parse_record(warc.info("a"))[0]["WARC-Type"] == "warcinfo"
