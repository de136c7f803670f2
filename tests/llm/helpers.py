"""Small tables with awkward rows, and brute-force versions of the shared word rules."""
import re

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower_az(text))


def space_words(text):
    return SPACE_WORD.findall(lower_az(text))


def rows(df, *names):
    return [tuple(r[n] for n in names) for r in df.collect()]


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


#: (doc_id, text): null and empty texts, ties, repeated rows, odd white space, a long text.
AWKWARD = [
    (1, "Plain words stand here, and more of them follow."),
    (1, "Plain words stand here, and more of them follow."),
    (2, None), (3, ""), (None, "a text without an id"), (None, None),
    (4, "  two  blanks \n \n and\tnew lines   é ü 漢字 \U0001f600 end "),
    (5, "x"), (6, "..."), (7, "word " * 5000 + "\n" + "other words " * 3000),
    (-9, "negative id"), (8, "Plain words stand here, and more of them follow, nearly."),
]


def awkward(spark):
    """The awkward rows with extra columns whose names clash with results of the operators."""
    rows_ = [(d, t, "s", 0.5, "l", 7, None) for d, t in AWKWARD]
    return spark.createDataFrame(rows_, "doc_id long, text string, source string, score double, labels string, "
                                        "n_words long, spans string")


def empty(spark):
    return awkward(spark).limit(0)
