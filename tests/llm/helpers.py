import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens string, kept string, spans string, k1 string, h int, component_id string, text_hash string"
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega " * 40


def sentence(seed, words):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 8))) for _ in range(words))


def texts():
    base = sentence(1, 120)
    near = base.split()
    near[60] = "changed"
    shared = sentence(2, 60)
    line = "this line stands in three documents"
    return [
        base,
        base,
        " ".join(near),
        sentence(3, 40) + "\n" + shared + "\n" + sentence(4, 30),
        sentence(5, 25) + " " + shared + " " + sentence(6, 25),
        sentence(7, 30) + "\n" + line + "\n" + sentence(8, 5),
        "  " + line.upper() + "\t\n" + sentence(9, 5),
        line + "\n" + sentence(10, 5),
        LONG,
        "x" * 700,
        "ab" * 300 + " tail",
        None,
        "",
        " \n\t ",
        "one",
        "two words",
        "été naïve 日本語 \U0001f600 it's <|endoftext|> 12345",
        "123 456 !!",
    ]


def rows():
    out = [(i, t, ("en", "fr", None)[i % 3], None if i == 4 else f"s{i % 2}", None if t is None else len(t), "a", "b", "c", "d", 1, "e", "f") for i, t in enumerate(texts())]
    out.append(out[3])  # a repeated row
    out.append((None, sentence(1, 120), "en", None, None, None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None, None, None))
    return out


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA)


def fold(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def multiset(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=repr)
