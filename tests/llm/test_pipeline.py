import corpus_pipeline as P

from textloom.llm import line_dedup, ngram_join, packing, pii, toxicity


def test_stages_follow_their_operators(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    assert [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "ngram_join", "pii", "packing"]
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = model.scorer()
    want = {k: t for k, t in before.items() if score(t) < 0.5}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            break
        assert docs.columns == columns
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "line_dedup":
            from tests.llm.test_line_dedup import brute

            want = brute(sorted(want.items()))
        if name == "ngram_join":
            from tests.llm.test_ngram_join import brute as components

            keep = {k for k, _, c in components(sorted(want.items()), 5) if k == c}
            want = {k: t for k, t in want.items() if k in keep}
        if name == "pii":
            want = {k: t for k, t in want.items()}
            weights = pii.fitted()
            for k, t in want.items():
                base = pii.base_spans(t or "")
                spans = sorted(base + pii.added_spans(t or "", base, weights), key=lambda s: (s[0], s[2]))
                end, text = 0, ""
                for s, e, kind in spans:
                    if s >= end:
                        text += t[end:s] + f"[{pii.KINDS[kind].upper()}]"
                    end = max(end, e)
                want[k] = text + t[end:] if t is not None else None
        assert got == want, name
    assert docs.selectExpr("sum(length)").first()[0] == docs.select("doc_id", "doc_tokens").distinct().selectExpr("sum(doc_tokens)").first()[0]
    assert {line_dedup, ngram_join, packing}


def staged(spark, tmp_path, rows):
    sf = "/root/testdata/sf0.001"
    columns = spark.read.parquet(f"{sf}/documents.parquet").schema
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1]) if r[1] else 0) for r in rows], columns)
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        out.write.mode("overwrite").parquet(str(tmp_path / name))
        if name != "packing":
            assert out.columns == columns.names
        docs = spark.read.parquet(str(tmp_path / name))
        yield name, docs.collect()


def test_missing_and_repeated_ids_ties_and_null_texts(spark, tmp_path):
    """Rows without id stay, whatever they say; rows that repeat an id stay or go together; null and empty texts stay."""
    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, long), (2, long + " more"), (2, "quite another text of its own"), (None, long), (None, None), (3, None), (4, ""), (5, "solo"), (5, "solo"), (6, "x " * 50_000 + "y")]
    left = {}
    for name, out in staged(spark, tmp_path, rows):
        left[name] = out
    ids = lambda name: sorted((r.doc_id for r in left[name]), key=lambda k: (k is None, k or 0))
    assert ids("toxicity") == ids("line_dedup") == [1, 2, 2, 3, 4, 5, 5, 6, None, None]
    texts = sorted((r.doc_id or 0, r.text or "") for r in left["line_dedup"])
    assert texts == sorted([(1, long), (2, ""), (2, "quite another text of its own"), (0, long), (0, ""), (3, ""), (4, ""), (5, "solo"), (5, "solo"), (6, rows[-1][1])])
    assert ids("ngram_join") == ids("line_dedup")
    assert sorted((r.doc_id or 0, r.text or "") for r in left["pii"]) == texts
    assert {r.doc_id for r in left["packing"]} == {1, 2, 3, 4, 5, 6, None} and sum(r.length for r in left["packing"]) >= 10


def test_empty_table(spark, tmp_path):
    assert all(out == [] for _, out in staged(spark, tmp_path, []))
