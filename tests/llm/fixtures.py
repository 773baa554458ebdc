"""Odd documents for every operator: nulls, empties, repeats, ties, long texts, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, text_md5 string, component_id long, rank int"
PROSE = "the quick brown fox jumps over the lazy dog and runs into the deep dark forest of the north where it sleeps for a very long winter under the old oak tree"


def odd(spark):
    rows = [
        (1, PROSE, "en", "src0"), (2, PROSE, "en", "src1"), (3, PROSE.replace("tree", "bush"), "en", "src2"), (4, None, "en", "src3"), (5, "", None, "src4"), (6, "  \n\t ", "de", None),
        (7, "one two", None, None), (7, "one two", None, None), (None, PROSE, "en", "src5"), (None, None, None, None), (8, "été \U0001f600 " * 40, "fr", "src6"), (9, (PROSE + "\n") * 300, "en", "src7"),
        (10, "shared line of boilerplate here\nown text of ten", "en", "src8"), (11, "shared line of boilerplate here\nown text of eleven", "en", "src9"), (12, "shared line of boilerplate here \nown text of twelve", "en", "src10"),
        (13, "a\0b  c \n d", "en", "src11"),
    ]
    return spark.createDataFrame([(i, t, l, s, None if t is None else len(t), "x", 99, 5) for i, t, l, s in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
