"""The pipeline's stages on a small folder, each against a plain version of its rule."""

import corpus_pipeline
from edge_rows import edited, frame, prose, rows
from test_llm_dedup import plain_components, plain_lines

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, tmp_path):
    passage = prose(45, 991).replace("\n", " ")
    base = prose(400, 990)
    docs = [(k, prose(80 + k, k), "en", f"s{k % 4}", 1) for k in range(60)]
    docs += [(100, base, "en", "s0", 1), (101, edited(base, 90, 5), "en", "s1", 1), (102, base + " " + passage, "en", "s2", 1)]
    docs += [(103, prose(90, 5) + "\n" + passage, "en", "s3", 1), (104, "too short", "en", None, 1), (105, None, None, None, None)]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return docs, passage


def test_stages(spark, tmp_path):
    docs, passage = folder(spark, tmp_path)
    sf = str(tmp_path)
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality rules", "line dedup", "near dedup", "decontamination", "packing"]

    good = steps["quality rules"](spark, frame, sf)
    assert good.columns == frame.columns
    good_rows = [tuple(r) for r in good.collect()]
    assert sorted(r[0] for r in good_rows) == sorted(d[0] for d in docs if d[1] and len(d[1].split()) >= 50)

    good = spark.createDataFrame(good_rows, COLUMNS)
    want = plain_lines([(r[0], r[1]) for r in good_rows], 3)
    short = [tuple(r) for r in steps["line dedup"](spark, good, sf).collect()]
    assert {r[0]: r[1] for r in short} == {d: t for (d, _), (t, _, _) in want.items()}
    assert all(r[4] == len(r[1]) for r in short)

    # near duplicates and leaks on the texts before line dedup, so that they are there to find
    near = [tuple(r) for r in steps["near dedup"](spark, good, sf).collect()]
    components = plain_components([(r[0], r[1]) for r in good_rows], 80)
    assert sorted(r[0] for r in near) == sorted(c[0] for c in components if c[3]) and 100 in {r[0] for r in near}
    clean = [r[0] for r in steps["decontamination"](spark, good, sf).collect()]
    assert sorted(clean) == sorted(r[0] for r in good_rows if passage not in " ".join(r[1].split()))
    packed = steps["packing"](spark, good, sf)
    assert packed.agg({"n_words": "sum"}).first()[0] == sum(len(r[1].split()) for r in good_rows)


def test_run(spark, tmp_path):
    folder(spark, tmp_path)
    out = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(range(60)) <= set(out) and 100 in out and not {102, 103, 104, 105} & set(out)


def test_kept_documents_lose_frequent_lines(spark):
    menu = "Home  News\tAbout us Contact"
    docs = [(k, f"{menu}\n{prose(80, 500 + k)}\n\nhome news about US contact ", "en", "s0", 1) for k in range(30)]
    docs += [(30, f"{menu}\n{prose(80, 530)}", "en", "s1", 1)]  # the line is rare on this host
    docs += [(31, "\n".join([menu] * 40 + [prose(60, 531)]), "en", "s0", 1)]
    docs += [(None, f"{prose(80, 532)}\n{menu}", "en", "s0", 1)] * 2
    want = {(d, prose(80, 500 + d) + "\n" if d < 30 else t) for d, t, *_ in docs if d is not None and d != 31}
    want.add((None, prose(80, 532)))
    frame = spark.createDataFrame(docs, COLUMNS).repartition(3)
    out = dict(corpus_pipeline.STAGES)["quality rules"](spark, frame, "")
    assert out.columns == frame.columns
    got = [tuple(r) for r in out.collect()]
    assert {(r[0], r[1]) for r in got} == want and len(got) == len(docs) - 1
    assert all(r[4] == len(r[1]) for r in got)


def test_near_copies_leave_one_document(spark):
    """A page copied forty times with small edits is no boilerplate of its host."""
    base = prose(300, 600).split("\n")
    docs = [(k, prose(90, 700 + k), "en", "s0", 1) for k in range(200)]
    for k in range(40):
        copy = list(base)
        copy[k % len(copy)] += f" edit{k}"
        docs.append((1000 + k, "\n".join(copy), "en", "s0", 1))
    table = spark.createDataFrame(docs, COLUMNS).repartition(5)
    steps = dict(corpus_pipeline.STAGES)
    good = steps["quality rules"](spark, table, "")
    assert good.count() == 240 and good.filter("doc_id >= 1000 and text like '%w%'").count() == 40
    kept = sorted(r["doc_id"] for r in steps["near dedup"](spark, good, "").collect())
    assert kept == [*range(200), 1000]


def test_stages_tell_documents_by_id_and_text(spark, tmp_path):
    """Null and repeated ids, repeated rows and clashing columns."""
    passage = prose(45, 991).replace("\n", " ")
    base = prose(300, 1)
    more = rows()[0][5:]
    docs = rows() + [
        (None, prose(70, 801) + "\n" + passage, "en", "s", 1, *more), (None, prose(70, 802), "en", "s", 1, *more),
        (3000, prose(70, 803) + " " + passage, "en", "s", 1, *more), (3000, prose(70, 804), "en", "s", 1, *more),
        (3001, prose(80, 805), "en", "s", 1, *more), (3001, edited(base, 60, 6), "en", "s", 1, *more), (None, edited(base, 70, 7), "en", "s", 1, *more),
    ]
    table = frame(spark, docs).withColumnRenamed("key", "__may").withColumnRenamed("rep", "__cut").withColumnRenamed("host", "key").withColumnRenamed("lines", "doc")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    steps = dict(corpus_pipeline.STAGES)

    def plain(rows_out):
        return sorted((str(r["doc_id"]), r["text"] or "") for r in rows_out)

    clean = steps["decontamination"](spark, table, str(tmp_path))
    assert clean.columns == table.columns
    assert plain(clean.collect()) == sorted((str(d), t or "") for d, t, *_ in docs if passage not in " ".join((t or "").split()))

    near = steps["near dedup"](spark, table, "")
    assert near.columns == table.columns
    # every (doc_id, text) as a document of its own; those without an id, and later texts of one, come last
    distinct = sorted({(d, t) for d, t, *_ in docs}, key=str)
    first = {d: min(str(t) for e, t in distinct if e == d) for d, _ in distinct}
    number = {x: k for k, x in enumerate(sorted(distinct, key=lambda x: (x[0] is None or (str(x[1]) != first[x[0]]), x[0] or 0)))}
    groups = {d: root for d, _, root, _ in plain_components([(number[x], x[1]) for x in distinct], 80)}
    got = [(r["doc_id"], r["text"]) for r in near.collect()]
    assert len(got) == len(set(got)) and sorted(groups[number[x]] for x in got) == sorted(set(groups.values()))
    named = {groups[number[x]]: x for x in got}
    for x in distinct:  # a document with an id of its own goes before one without
        if x[0] is not None and str(x[1]) == first[x[0]]:
            kept = named[groups[number[x]]]
            assert kept[0] is not None and kept[0] <= x[0]

    short = steps["line dedup"](spark, table, "")
    assert short.columns == table.columns and short.count() == len(docs)
    assert sorted(r["__may"] for r in short.select("__may").collect()) == sorted(r["__may"] for r in table.select("__may").collect())
    good = steps["quality rules"](spark, table, "")
    assert good.columns == table.columns and good.filter("doc_id = 2").count() == 1
    assert steps["packing"](spark, table, "").count() >= len(docs)
