import random

from panelmill.llm.license_scan import BASE, NOTICES, plain_words, scan, templates
from tests.conftest import SF_SMALL
from tests.llm.helpers import WORDS, edge_docs, edge_rows, empty_docs

NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def at(words, phrase, i):
    return i >= 0 and tuple(words[i:i + len(phrase)]) == tuple(phrase)


def brute(docs, rare=3, common=0.05, share=0.6):
    """Every template is tried at every place; a place counts if enough of its rare words stand there."""
    texts = [(i, plain_words(x or "")) for i, x in docs]
    df = {}
    for _, w in texts:
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    out = []
    for i, w in texts:
        base = [(k, label) for phrase, label in BASE for k in range(len(w)) if at(w, plain_words(phrase), k)]
        score, labels = (0.5 if base else 0.0), {label for _, label in base}
        for t in templates((), NOTICES):
            known = sorted((df[x], x) for x in set(t.words) if x in df)
            keys = {x for k, (n, x) in enumerate(known[:rare]) if k == 0 or n <= common * len(texts)}
            for k in range(-len(t.words), len(w) if known else 0):
                here = [0 <= k + j < len(w) and w[k + j] == x for j, x in enumerate(t.words)]
                votes = sum(h and x in keys for h, x in zip(here, t.words))
                if votes >= min(2, len(keys)) and all(h or not m for h, m in zip(here, t.must)):
                    part = sum(here) / len(t.words)
                    score = max(score, part)
                    labels |= {t.label} if part >= share else set()
        out.append((i, len(w), len(base), min((k for k, _ in base), default=None), max((k for k, _ in base), default=None),
                    ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def made(n=120):
    """Texts with notices whole, cut, changed and repeated between other words, of which some are licence words."""
    rnd = random.Random(9)
    loose = WORDS + ["license", "under", "the", "public", "mit", "by", "cc", "version", "3", "0", "gnu"]
    rows = []
    for i in range(n):
        words = [rnd.choice(loose) for _ in range(rnd.choice([0, 3, 40]))]
        for _ in range(rnd.choice([0, 0, 1, 1, 3])):
            notice = list(plain_words(rnd.choice(NOTICES)[1] if rnd.random() < 0.7 else rnd.choice(BASE)[0]))
            if rnd.random() < 0.4:
                notice[rnd.randrange(len(notice))] = rnd.choice(loose)
            if rnd.random() < 0.3:
                notice = notice[rnd.randrange(3):]
            words += [*notice, *(rnd.choice(loose) for _ in range(rnd.choice([0, 1, 5])))]
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(rnd.choice([w, w, w.upper()]) for w in words)))
    return rows


def test_made_texts(spark):
    rows = made()
    want = brute(rows)
    assert {x for w in want for x in w[6].split(",")} >= {"gpl", "apache-2.0", "cc-by", "mit"} and {w[7] for w in want} >= {0.0, 0.5, 1.0}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(scan(docs)) == want
    assert result(scan(docs, common=1.0)) == brute(rows, common=1.0)
    assert result(scan(docs, rare=1, common=0.0)) == brute(rows, rare=1, common=0.0)


def test_base_places_do_not_hang_on_other_rare_words(spark):
    """The phrase's words are frequent, other licence words are rarer, and all places count."""
    rows = [(i, "cc by license mit general public") for i in range(50)]
    rows += [(90, "gnu mozilla redistribution cc BY x cc-by mit License MIT LICENSE gnu general public license"), (91, "ccc by mits license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in scan(docs).collect()}
    r = got[90]
    assert (r.n_base, r.first_word, r.last_word, r.base_labels) == (5, 3, 12, "cc-by,gpl,mit")
    assert (got[91].n_base, got[91].score, got[0].n_base, got[0].score) == (0, 0.0, 1, 0.5)


def test_edges(spark):
    rows = [(r[0], r[1]) for r in edge_rows()]
    assert result(scan(edge_docs(spark))) == brute(rows) and scan(empty_docs(spark)).count() == 0
    long = " ".join(["mit license by cc"] * 20000)
    docs = spark.createDataFrame([(1, long), (None, "Apache License")], "doc_id long, text string")
    got = {r.doc_id: r for r in scan(docs).collect()}
    assert (got[1].n_base, got[1].last_word, got[None].base_labels) == (20000, 79996, "apache")


def test_whole_small_table_without_python(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    df = scan(docs)
    assert result(df) == brute([(r.doc_id, r.text) for r in docs.collect()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Exchange"))
