import string

from textloom.plans import catalogue

WORD = frozenset(string.ascii_letters + string.digits + "_")


def of(text):
    """How often `of` stands between characters that are no ASCII word characters."""
    t = f" {text} "
    return sum(t[i : i + 2] == "of" and t[i - 1] not in WORD and t[i + 2] not in WORD for i in range(1, len(t) - 2))


def test_whole_word_reads_every_document(spark, tmp_path):
    texts = [("en", "of the of, soft of_x offer\nof"), ("en", "a café of note 🙂of🙂 éof ofé"), ("de", "of"), (None, "one of two"), ("fr", "Ofen, profil"), ("en", None), ("en", ""), ("zh", "的of的 of1 1of -of-")]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {str(i): n for i, t, _ in rows if (n := of(t or ""))}
    assert {r.file: r.n for r in catalogue.QUERIES["whole_word"](spark, str(tmp_path)).collect()} == want
    assert len(want) == 5
