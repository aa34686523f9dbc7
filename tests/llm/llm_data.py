"""Small documents with every odd case, and the SQL side of the comparison."""

from compare import same, spark_rows, sql_rows

WORDS = "the quick brown fox jumps over a lazy dog while seven wizards quietly box five dozen liquor jugs near old mills".split()


def prose(seed: int, count: int) -> str:
    state, out = seed * 7919 + 1, []
    for _ in range(count):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[state // 65536 % len(WORDS)] + str(state // 1024 % 7))
    return " ".join(out)


LONG = prose(99, 400_000)  # longer than a piece of the word scanner

#: doc_id, text, lang, source, n_chars and columns named like results
ODD_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot int, score string, kept int, topic int, _spans int, _piece int, _tokens int"


def odd_rows(long_text: bool = True):
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", "a"), (4, None, "en", "a"),
        (5, "", None, "b"), (6, "  \t\n ", "de", None), (7, "one two", "de", "b"), (8, "One  Two", None, None), (9, "x", "fr", "b"),
        (10, "...!!! ###", "fr", "a"), (None, base, "en", "a"), (None, None, None, None), (11, prose(2, 80), "es", "a"),
        (12, "日本 語 ñandú ÉÉÉ", "es", "b"), (13, prose(1, 30) + " " + prose(3, 30), "en", "b"), (-5, "minus", "en", "b"),
    ]
    if long_text:
        rows.append((14, LONG, "en", "a"))
    return [(i, t, lang, source, None if t is None else len(t), "s", 1, "x", 2, 3, 4, 5, 6) for i, t, lang, source in rows]


def odd_documents(spark, long_text: bool = True):
    return spark.createDataFrame(odd_rows(long_text), ODD_COLUMNS).repartition(3)


def empty_documents(spark):
    return spark.createDataFrame([], ODD_COLUMNS)


def assert_same_as_sql(df, database, sql):
    names, rows = spark_rows(df)
    sql_names, expected = sql_rows(database, sql)
    assert names == sql_names
    assert len(rows) == len(expected)
    assert [(a, b) for a, b in zip(rows, expected) if not same(a, b)] == []
