from tidemark.llm import quality, queries


def brute(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n ", "a b c a b c a", "x\nx\n\nx \nx", "é#|ü <b> *", "w " * 120, "\n".join(["one two"] * 30), " ".join(f"w{i}" for i in range(80))]


def test_counts_match_brute_force(docs):
    found = {r.doc_id: tuple(r)[1:6] for r in quality.verdicts(docs(list(enumerate(TEXTS)))).collect()}
    assert found == {i: brute(t) for i, t in enumerate(TEXTS)}


def test_outliers_go_and_clean_documents_stay(docs):
    clean = [(i, " ".join(f"word{(i * 31 + k * 17) % 997}" for k in range(100))) for i in range(80)]
    junk = [(1000, " ".join(f"w{k}###" for k in range(100))), (1001, " ".join("abcdefghij" * 3 + str(k) for k in range(100)))]
    table = docs(clean + junk + [(None, None), (5, clean[5][1])])
    kept = {r.doc_id for r in quality.verdicts(table).where("kept").collect()}
    assert kept == {i for i, _ in clean}
    left = quality.filtered(table)
    assert left.columns == table.columns and left.count() == 81
    assert quality.verdicts(table.limit(0)).count() == 0


def test_sql_is_there():
    assert "op2_quality_rules" in queries.ORACLE_SQL
