from collections import Counter, defaultdict

from treeloom.llm import subjects


def test_words_are_counted_over_all_documents(spark):
    text = "The judge heard the attorney and the plaintiff before the zyxwort session."
    talk = "Nothing in particular happened on the way home today."
    docs = [(i, text if i % 1000 == 7 else talk) for i in range(13_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    counts = subjects._word_counts(df)
    lex, by_class = subjects.Lexicon(), defaultdict(Counter)
    for _, t in docs:
        subjects.count_words(t, lex, by_class)
    want = {(k, w): n for k, of in by_class.items() for w, n in of.items() if len(w) > 2 or not w}
    assert counts == {k: n for k, n in want.items() if k[1] == "" or sum(want[x] for x in want if x[1] == k[1]) >= subjects.LEAST}
    assert counts["law", "zyxwort"] == 13
    model, met = subjects.word_tables(counts)
    assert met == ["law"] and model.keeps["zyxwort"][0] == "law"
