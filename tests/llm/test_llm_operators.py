"""Sharding, decontamination, quality, packing, archives, URL and license operators on edge rows."""

import random
import re
import time
import zlib

import numpy as np
import pytest
from edge_rows import SCHEMA, empty, frame, prose, rows

from paceforge.llm import (
    histogram_sort,
    license_scan,
    line_quality,
    packing,
    qgram_decontam,
    url_globs,
    warc,
)


def test_shards(spark):
    some = rows() + [rows()[8]] * 60  # one row many times
    got = histogram_sort.shard_by_bytes(frame(spark, some), 5, cells_per_shard=3).collect()
    assert len(got) == len(some)
    sizes = {}
    for r in got:
        sizes.setdefault(r["shard"], []).append((r["slot"], -1 if r["doc_id"] is None else r["doc_id"], r["size"]))
    last = -2
    for shard in sorted(sizes):
        own = sorted(sizes[shard])
        assert [s for s, _, _ in own] == list(range(len(own)))
        ids = [d for _, d, _ in own]
        assert ids == sorted(ids) and ids[0] >= last
        last = ids[-1]
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in some)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_shards_are_even(spark):
    df = spark.range(3000).selectExpr("if(id < 2900, 7, id * 1000000007) AS doc_id", "repeat('x', cast(id % 50 AS int)) AS text")
    got = histogram_sort.shard_by_bytes(df, 8).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in got)
    assert len(got) == 8 and max(abs(r[1] - total / 8) for r in got) <= 80


def test_splitters_match_prefix_sums(spark):
    """Every shard border is the row border nearest to its target, up to the tolerance, by plain sums."""
    rnd = random.Random(2)
    sizes = [rnd.choice([1, 5, 40, 900, 5000]) for _ in range(2_000)]
    keys = sorted(rnd.choice([7, 7, 8, rnd.randint(0, 10**12)]) for _ in sizes)
    table = spark.createDataFrame(list(zip(keys, range(len(keys)), sizes)), "key long, tie long, size long").repartition(4)
    for shards, tolerance in ((5, 0.002), (16, 0.0)):
        bounds, counts = histogram_sort.find_splitters(table, shards, shards, tolerance)
        below = np.concatenate([[0], np.cumsum(sizes)])
        for i, bound in enumerate(bounds, start=1):
            place = sum((k, t) < (bound // (1 << 63), bound % (1 << 63)) for t, k in enumerate(keys))
            assert counts[bound] == (below[place], place)
            target = sum(sizes) * i // shards
            assert abs(below[place] - target) <= max(np.abs(below - target).min(), int(tolerance * sum(sizes) / shards))


def test_sharded_rows_keep_their_columns(spark):
    docs = frame(spark)
    got = histogram_sort.shard_by_bytes(docs, 5, whole_rows=True)
    back = got.select("doc.*")
    assert back.columns == docs.columns
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    wrong = got.filter("NOT doc.doc_id <=> doc_id OR size <> coalesce(octet_length(doc.text), 0) + 16")
    assert wrong.count() == 0


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item):
        nxt = [i + 1]
        for j, x in enumerate(text):
            nxt.append(min(row[j] + (c != x), row[j + 1] + 1, nxt[j] + 1))
        row = nxt
    return min(row)


def test_leaks_match_the_plain_distance():
    rnd, found = random.Random(4), 0
    for _ in range(120):
        item = "".join(rnd.choice("abcde ") for _ in range(rnd.randint(25, 80)))
        text = list(item)
        for _ in range(rnd.randint(0, 7)):
            k = rnd.randrange(len(text))
            text[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "é"])
        text = "ab c" * rnd.randint(0, 9) + "".join(text) + "c ba" * rnd.randint(0, 9)
        index = qgram_decontam.PassageIndex([(1, item)], 6, 8)
        hits, least = index.find(text), plain_distance(item, text)
        assert bool(hits) == (least <= index.budget[0])
        if hits:
            found += 1
            assert hits[0][3] == least == plain_distance(item, text[hits[0][1] : hits[0][2]])
    assert found > 30


@pytest.mark.parametrize("block", [4_000_000, 100])
def test_leaks(spark, block):
    passage = prose(40, 7777).replace("\n", " ")
    docs = rows() + [
        (901, prose(80, 3) + " " + passage.upper() + "\n" + prose(9, 4), "en", "s", 1, *rows()[0][5:]),
        (902, prose(80, 5) + " " + passage.replace("w1", "v1", 3), "en", "s", 1, *rows()[0][5:]),
    ]
    bench = spark.createDataFrame([(1, passage, 5), (2, None, 5), (3, " ", 5), (4, "unseen text " * 9, 5), (5, "zz", 5)], "item_id long, text string, start int")
    got = qgram_decontam.find_leaks(frame(spark, docs), bench, block_chars=block).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(901, 1), (902, 1)]
    twice = spark.createDataFrame([(1, passage), (1, passage[:150])], "item_id long, text string")
    got = qgram_decontam.find_leaks(frame(spark, docs), twice, block_chars=block).filter("doc_id = 901").collect()
    assert sorted((r["item_id"], r["item_chars"]) for r in got) == [(1, len(passage[:150].strip())), (1, len(passage))]
    assert qgram_decontam.find_leaks(empty(spark), bench).count() == 0
    assert qgram_decontam.find_leaks(frame(spark), bench.limit(0)).count() == 0


def test_quality(spark):
    common = "buy now at our shop"
    docs = rows() + [(1000 + k, "\n".join([common] * 12) + "\n" + prose(15, 5000 + k), "en", "hub", 1, *rows()[0][5:]) for k in range(40)]
    docs += [(2000 + k, prose(90, 3000 + k), "en", "hub", 1, *rows()[0][5:]) for k in range(40)]
    got = {(r["doc_id"], r["text_id"]): r for r in line_quality.line_frequency_rules(frame(spark, docs)).collect()}
    by_id = {k[0]: r for k, r in got.items()}
    assert all(by_id[2000 + k]["kept"] for k in range(40))
    assert by_id[1000]["n_removed_words"] == 60 and not by_id[1000]["kept"]
    assert by_id[20]["n_removed_words"] == 8 and by_id[20]["kept"]
    assert by_id[5]["n_words"] == 0 and by_id[5]["base_failed"]
    assert by_id[15]["n_dup_lines"] == 8 and by_id[14]["n_repeat_words"] == 300 and by_id[14]["base_failed"]
    assert line_quality.line_frequency_rules(empty(spark)).count() == 0
    text = "a#b é\nA#B é\na#b é"
    one = line_quality.line_frequency_rules(frame(spark, [(1, text, None, None, None, *rows()[0][5:])])).first()
    assert one[1:6] == (6, 12, 3, 1, 0)
    assert one["host"] == ""


def test_lines_are_counted_by_families(spark):
    more = rows()[0][5:]
    base = prose(280, 60).split("\n")
    copies = [(k, "\n".join(base[: k % 20] + [f"edit {k}"] + base[k % 20 :]), "en", "a", 1, *more) for k in range(60)]
    banner = [(100 + k, f"we use cookies\non this site\n{prose(80, 900 + k)}", "en", "b", 1, *more) for k in range(60)]
    # on a large host a line in few of a hundred documents
    large = [(1000 + k, ("home and contact\n" if k % 25 == 0 else "") + prose(60, 2000 + k), "en", "c", 1, *more) for k in range(1500)]
    table = frame(spark, copies + banner + large)
    got = {r["doc_id"]: r for r in line_quality.line_frequency_rules(table).collect()}
    assert all(got[k]["kept"] and got[k]["n_removed_words"] == 0 for k in range(60))
    assert all(got[100 + k]["n_removed_words"] == 6 for k in range(60))
    assert got[1000]["n_removed_words"] == 0
    low = {r["doc_id"]: r for r in line_quality.line_frequency_rules(table, limit_any=50).collect()}
    assert low[1000]["n_removed_words"] == 3 and all(low[k]["n_removed_words"] == 0 for k in range(60))


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for z, s, c in zip(sizes, sources, clusters):
        fits = [(capacity - sum(x[0] for x in b), i) for i, b in enumerate(bins) if sum(x[0] for x in b) + z <= capacity and not any((s >= 0 and x[1] == s) or (c >= 0 and x[2] == c) for x in b)]
        if not fits:
            bins.append([])
            fits = [(capacity, len(bins) - 1)]
        room, i = min(fits)
        bins[i].append((z, s, c))
        out.append((i, capacity - room))
    return out


def test_best_fit_takes_the_tightest_compatible_bin():
    rnd = random.Random(8)
    for _ in range(60):
        n, cap = rnd.randint(0, 60), rnd.randint(10, 60)
        sizes = sorted((rnd.randint(1, cap) for _ in range(n)), reverse=True)
        sources = [rnd.choice([-1, 0, 0, 1, 2, 3]) for _ in range(n)]
        clusters = [rnd.choice([-1, 0, 1, 5, 6, 7, 8]) for _ in range(n)]
        assert packing.best_fit(sizes, sources, clusters, cap) == plain_best_fit(sizes, sources, clusters, cap)


def test_packing(spark):
    some = rows() + [rows()[0]] * 30
    got = packing.pack_documents(frame(spark, some), capacity=500, group_rows=25).collect()
    words = sum(len((r[1] or "").split()) for r in some)
    assert sum(r["n_words"] for r in got) == words
    assert sorted(str(r["doc_id"]) for r in got if r["piece"] == 0) == sorted(str(r[0]) for r in some)
    bins = {}
    for r in got:
        assert (r["bin"] is None) == (r["n_words"] == 0)
        if r["bin"]:
            bins.setdefault(r["bin"], []).append(r)
    for own in bins.values():
        own.sort(key=lambda r: r["bin_offset"])
        assert [r["bin_offset"] for r in own] == np.cumsum([0] + [r["n_words"] for r in own[:-1]]).tolist()
        assert sum(r["n_words"] for r in own) == own[0]["bin_words"] <= 500
        for c in ("source", "cluster"):
            known = [r[c] for r in own if r[c] is not None]
            assert len(known) == len(set(known))
    assert packing.pack_documents(empty(spark)).count() == 0
    assert packing.pack_documents(frame(spark), cluster="lang").filter("bin is not null").count() > 0


PAGES = "page_id long, url string, html string, body string, same string, u string, name string, rule string"


def page_frame(spark, some):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in some], PAGES).repartition(2)


def test_archives(spark, tmp_path):
    some = [(1, "http://a/", "x" * 5000), (2, None, "x" * 5000), (3, "http://b\r\nX: y", "x" * 5000), (4, "u", None), (5, "u", ""), (6, "é", "<p>é\r\n\r\nz</p>")]
    some += [(None, "u", "only"), (None, "u", "only"), (7, "u", "t"), (7, "u", "t"), (8, "u", "long " * 40_000)]
    archives = warc.write_archives(page_frame(spark, some), archive_bytes=6000)
    got = sorted(map(tuple, warc.read_records(archives).collect()), key=str)
    want = []
    for page, _, html in some:
        body = (html or "").encode()
        same = [p for p, _, h in some if (h or "").encode() == body and p is not None]
        best = max(same, default=None)
        revisit = best is not None and page != best
        want.append((page, len(body), warc.payload_digest(body), "revisit" if revisit else "response", best if revisit else None))
    assert got == sorted(want, key=str)
    warc.export_archives(archives, str(tmp_path / "out"))
    files = list((tmp_path / "out").iterdir())
    assert sum(len(list(warc.read_archive(f.read_bytes()))) for f in files) == len(some)
    assert all(f.read_bytes()[:4] == (0x184D2A5D).to_bytes(4, "little") for f in files)
    least = warc.read_records(warc.write_archives(page_frame(spark, some), least_bytes=2)).filter("record_type = 'revisit'")
    assert sorted(r["page_id"] for r in least.collect()) == [1, 2]
    assert warc.read_records(warc.write_archives(page_frame(spark, some[:1]).limit(0))).count() == 0


def test_records_have_all_mandatory_fields(spark):
    some = [(1, "http://a/", "x" * 500), (2, None, "x" * 500), (None, "u", "only"), (None, "u", "only"), (7, "u", "t"), (7, "u", "t"), (6, "u", "t")]
    archives = warc.write_archives(page_frame(spark, some), archive_bytes=900, date="2024-05-01T00:00:00Z")
    records = [warc.parse_record(r) for a in archives.collect() for r in warc.read_archive(a["content"])]
    assert len(records) == len(some)
    for fields, body in records:
        assert fields["WARC-Date"] == "2024-05-01T00:00:00Z" and fields["WARC-Type"] in ("response", "revisit")
        assert re.fullmatch(r"<urn:uuid:[0-9a-f-]{36}>", fields["WARC-Record-ID"]) and int(fields["Content-Length"]) == len(body)
    ids = [f["WARC-Record-ID"] for f, _ in records]
    assert len(set(ids)) == len(ids)
    by_id = {f["WARC-Record-ID"]: f for f, _ in records}
    revisits = [f for f, _ in records if f["WARC-Type"] == "revisit"]
    assert sorted(f["X-Page-ID"] for f in revisits) == ["1", "6"]
    for f in revisits:
        named = by_id[f["WARC-Refers-To"]]
        assert named["WARC-Type"] == "response" and named["X-Page-ID"] == f["X-Refers-To-Page-ID"]
        assert named["WARC-Payload-Digest"] == f["WARC-Payload-Digest"]


def test_archives_are_read_in_linear_time():
    def seconds(n):
        content = warc.pack_archive([b"record %d " % i * 20 for i in range(n)])
        begun = time.time()
        assert sum(1 for _ in warc.read_archive(content)) == n
        return time.time() - begun

    few, many = seconds(8_000), seconds(64_000)
    assert many < 20 * few + 1


def test_archive_round_trip_and_damage():
    records = [b"r%d " % i * (i * 37) for i in range(1, 60)] + [b""]
    content = warc.pack_archive(records)
    assert list(warc.read_archive(content)) == records
    with pytest.raises(Exception):
        list(warc.read_archive(content[:-3]))


def glob_regex(glob):
    host, slash, path = glob.partition("/")
    return re.compile(re.escape(host).replace(r"\*", "[^/]*") + slash + re.escape(path).replace(r"\*", ".*"), re.S)


def test_automaton_matches_regular_expressions():
    rnd = random.Random(6)
    # Few stars a glob, as the regular expressions they are compared with backtrack.
    globs = ["*".join("".join(rnd.choice("ab./") for _ in range(rnd.randint(0, 9))) for _ in range(rnd.randint(1, 3))) for _ in range(60)]
    globs += ["*", "*/*", "a*", "*a", "*/", "b" * 70 + "*"]
    machine = url_globs.compile_globs(globs)
    urls = ["".join(rnd.choice("aab./") for _ in range(rnd.randint(0, 60))) for _ in range(300)] + ["", "a" * 5000, "b" * 90]
    got = machine.matches([u.encode() for u in urls], cells=3000)
    want = np.array([[bool(glob_regex(g).fullmatch(u)) for g in globs] for u in urls])
    assert (got == want).all() and want.any(axis=0).sum() > 5


def test_urls(spark):
    some = [
        (1, "http://A.Example.NET/en/x?q"), (2, "https://example.net/fr/"), (3, "x://net"), (4, "x://net/"), (5, None), (6, "nothing"),
        (7, "http://b.org/fr/x#y"), (8, "http://org?/fr/"), (9, "http://adult-x.example.com/en/1"), (10, "http://notnet/"), (None, "a://h/é" + "z" * 9000),
        (11, "http://m.example.com/de/1"), (12, "://example.net/en/"), (13, "http://x.com/y/login?a"), (13, "http://x.com/y/login?a"),
    ]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_globs.filter_urls(page_frame(spark, [(*r, "h") for r in some])).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("net", "", None, "allow") and got[4][2:] == ("net/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2:] == ("org/fr/", "allow")
    assert got[8] == ("org", "", None, "allow") and got[9][2:] == (None, "block") and got[10][2:] == (None, "allow")
    assert got[11][2:] == ("example.com/de/", "block") and got[12][2] == "example.net/en/" and got[13][2:] == (None, "block")
    assert got[None][3] == "allow"


def test_licenses(spark):
    texts = [
        (1, "See the MIT  License, mit-LICENSE!\nmit_license"), (2, None), (3, ""), (4, "GNU general\npublic license"),
        (5, "x\nLicensed under CC BY-NC 4.0.\ny"), (6, "licensed under cc by"), (7, "licensé license"), (None, "apache license"), (8, "license mit"),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, [(d, t, None, None, None, *rows()[0][5:]) for d, t in texts])).collect()}
    assert got[1][1:8] == (8, 3, 2, 6, "mit", "mit", 1.0)
    assert got[1]["base_labels"] == "mit" and got[4]["base_labels"] == "gpl" and got[4]["first_word"] == 1
    assert got[2][1:8] == got[3][1:8] == (0, 0, None, None, "", "", 0.0)
    assert got[5]["labels"] == "cc-by-nc" and got[5]["base_labels"] == ""
    assert (got[5]["blocks"][0]["first"], got[5]["blocks"][0]["end"]) == (1, 8)
    assert got[6]["labels"] == got[7]["labels"] == got[8]["labels"] == "" and got[None]["labels"] == "apache"
    assert license_scan.scan_licenses(empty(spark)).count() == 0


def test_wrapped_notices_and_scattered_words(spark):
    mit, gpl = license_scan.TEMPLATES[0][1].split(), license_scan.TEMPLATES[6][1].split()
    wrapped = "\n".join(" * " + " ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    edited = "# " + "\n# ".join(" ".join(gpl[i : i + 7]) for i in range(0, len(gpl), 7)).replace("redistribute", "copy")
    texts = [
        (1, prose(60, 1) + "\n" + wrapped + "\n" + prose(40, 2)), (2, edited), (3, "Her speech about rights was reserved for all guests"),
        (4, "all\nrights\n\nreserved"), (5, " ".join(w + " " + prose(9, i) for i, w in enumerate(mit))),
    ]
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(frame(spark, [(d, t, None, None, None, *rows()[0][5:]) for d, t in texts])).collect()}
    assert [got[d]["labels"] for d in range(1, 6)] == ["mit", "gpl", "", "all-rights-reserved", ""]
    block = got[1]["blocks"][0]
    assert block["containment"] == 1 and (block["first"], block["end"]) == (60, 60 + len(license_scan.tokens(" ".join(mit).encode())))
    assert got[2]["score"] == 1 and got[2]["blocks"][0]["containment"] < 1


def test_template_filters_lose_nothing():
    rnd = random.Random(9)
    words = [f"t{i}" for i in range(25)]
    templates = [(str(i), " ".join(rnd.sample(words, rnd.randint(1, 12)))) for i in range(15)]
    for threshold in (0.5, 0.8, 1.0):
        index = license_scan.TemplateIndex(templates, {w.encode(): rnd.randint(0, 5) for w in words}, threshold)
        for _ in range(200):
            text = [rnd.choice(words + ["x"] * 20).encode() for _ in range(rnd.randint(0, 40))]
            want = {}
            for i, (_, t) in enumerate(templates):
                own = {w.encode() for w in t.split()}
                span = license_scan.block_words(t.split())
                most = max((len(own & set(text[at : at + span])) for at in range(len(text))), default=0)
                if most >= max(1, threshold * len(own) - 1e-9):
                    want[i] = most / len(own)
            found = {}
            for i, first, end, c in index.matches(text):
                own = {w.encode() for w in templates[i][1].split()}
                assert c == len(own & set(text[first:end])) / len(own) and end - first <= index.span[i]
                found[i] = max(c, found.get(i, 0))
            assert found == want


def test_schema_has_clashing_names():
    assert len(rows()[0]) == len(SCHEMA.split(","))
