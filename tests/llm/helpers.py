"""Small document tables with the awkward cases."""

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, key string, label int"
PASSAGE = " ".join(f"passage{i} shared" for i in range(40))


def rows():
    long_text = " ".join(f"word{i % 977}x{i}" for i in range(12000))
    texts = [
        (1, "the quick brown fox jumps over the lazy dog again and again today"),
        (2, "The quick brown fox jumps over the lazy dog again and again today"),
        (3, None),
        (4, ""),
        (5, "start one " + PASSAGE + " end of the first"),
        (6, "another way to begin\nwith lines\nwith lines\n" + PASSAGE + "\nand some other tail é ü"),
        (7, long_text),
        (8, long_text),
        (9, "a" * 1500),
        (9, "same id another text, with enough words to be kept by the rules of quality"),
        (10, "same row same row\nsame row"),
        (10, "same row same row\nsame row"),
        (11, "Ünïcödé wörds – ß ſ 漢字 <b>#*$%&|</b> MIT License and the Apache\tLicense"),
    ]
    return [(i, t, "en", ["s1", None, "s2"][k % 3], len(t or ""), "clash", "clash", 0) for k, (i, t) in enumerate(texts)]


def docs(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOC_SCHEMA)


def empty(spark):
    return spark.createDataFrame([], DOC_SCHEMA)
