"""Benchmark windows found in documents, against a plain search over templates."""

import random

from oddrows.llm import decontaminate, queries

BENCH = "item_id long, text string, doc_id long, key string"
QUESTION = "Anna has 12 apples and gives 5 of them to Bernd who already holds 7 pears so how many apples does Anna keep"


def items(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], BENCH)


def found(df):
    return {(r["doc_id"], r["item_id"]) for r in df.collect()}


def test_reworded_questions(spark, documents):
    bench = items(spark, [(1, QUESTION), (2, None), (3, ""), (4, "too short item"), (5, "it weighs 3 kg exactly"), (6, QUESTION.lower())])
    other = QUESTION.replace("Anna", "Maria").replace("12", "340").replace("5", "1.5").replace("Bernd", "Otto")
    rows = [
        (1, f"Before that. {QUESTION}? And after."),
        (2, other.upper().replace("MARIA", "Maria").replace("OTTO", "Otto")),
        (3, "words before " + other),
        (4, "Anna has 12 apples"),
        (5, "they say it weighs 70 kg exactly or so"),
        (6, "they say it weighs three kg exactly"),
        (7, None),
        (8, ""),
        (9, " ".join(["Ab 1 Cd 2"] * 500)),
        (10, QUESTION.replace("pears", "plums").replace("gives", "sells")),
        (None, QUESTION),
        (1, f"Before that. {QUESTION}? And after."),
    ]
    out = decontaminate.leaks(documents(rows), bench)
    got = found(out)
    assert {(1, 1), (2, 1), (3, 1), (None, 1), (5, 5)} <= got
    assert not {d for d, _ in got} & {4, 6, 7, 8, 9, 10}
    by = {(r["doc_id"], r["item_id"]): r for r in out.collect()}
    assert by[1, 1]["coverage"] == 1 and not by[1, 1]["changed"]
    assert by[3, 1]["coverage"] == 1 and by[3, 1]["changed"] and by[3, 1]["first_at"] == 2
    assert by[5, 5]["changed"]


def test_slots_must_be_consistent(spark, documents):
    bench = items(spark, [(1, "x Anna y Bernd z Anna q r s t u v")])
    rows = [(1, "x Eva y Otto z Eva q r s t u v"), (2, "x Eva y Otto z Otto q r s t"), (3, "x Eva y Eva z Eva q r s t")]
    assert found(decontaminate.leaks(documents(rows), bench)) == {(1, 1)}


def test_clean_documents(spark, documents):
    bench = items(spark, [(1, QUESTION)])
    df = documents([(1, QUESTION), (2, "clean"), (2, "clean"), (None, None), (None, "tail " + QUESTION), (3, "")])
    left = decontaminate.clean_documents(df, bench)
    assert left.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted([(2, "clean"), (2, "clean"), (None, None), (3, "")], key=repr)
    assert decontaminate.leaks(documents([]), bench).collect() == []
    assert decontaminate.leaks(df, items(spark, [])).collect() == []
    assert decontaminate.clean_documents(df, items(spark, [])).count() == 6


def test_blocks_of_the_benchmark(spark, documents, monkeypatch):
    draw = random.Random(2)
    word = lambda: "".join(draw.choice("abcdefg") for _ in range(6))
    bench = [(k, " ".join(word() for _ in range(draw.randint(3, 30)))) for k in range(40)]
    rows = [(k, " ".join([word(), *bench[k % 40][1].split()[draw.randint(0, 3) :], word()])) for k in range(120)]
    want = found(decontaminate.leaks(documents(rows), items(spark, bench)))
    monkeypatch.setattr(decontaminate, "BLOCK", 50)
    assert found(decontaminate.leaks(documents(rows), items(spark, bench))) == want
    brute = set()
    for d, t in rows:
        w = t.split()
        for i, b in bench:
            u = b.split()
            n = min(10, len(u))
            grams = {tuple(u[k : k + n]) for k in range(len(u) - n + 1)}
            if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
                brute.add((d, i))
    assert want == brute


def window_forms(parts, width):
    """Plain templates of all windows: (place, first part taken alone, template, values in its slots, words, whether words are the most)."""
    for at in range(len(parts) - width + 1):
        window = parts[at : at + width]
        words = tuple(value for _, _, value in window)
        for alone in (False, True):
            kinds = [window[0][alone], *[inside for inside, _, _ in window[1:]]]
            template = tuple(value if kind < 0 else f"<{kind}>" for kind, value in zip(kinds, words))
            values = [(kind, value) for kind, value in zip(kinds, words) if kind >= 0]
            yield at, alone, template, values, words, 2 * (width - len(values)) > width


def leaks_brute(docs, bench):
    """(document, item) pairs by comparing templates as they are, without hashes."""
    templates, verbatim, widths = {}, {}, set()
    for item, text in bench:
        parts = decontaminate.all_parts((text or "").split())
        width = min(decontaminate.WIDTH, len(parts))
        if not width:
            continue
        widths.add(width)
        for _, alone, template, values, words, literal in window_forms(parts, width):
            if literal and width >= decontaminate.LEAST:
                templates.setdefault(template, []).append((item, values))
            elif not alone:
                verbatim.setdefault(words, set()).add(item)
    found = set()
    for doc, text in docs:
        parts = decontaminate.all_parts((text or "").split())
        for width in widths:
            for _, _, template, values, words, _ in window_forms(parts, width):
                found |= {(doc, item) for item in verbatim.get(words, ())}
                for item, wanted in templates.get(template, ()):
                    if len(set(zip(values, wanted))) == len(set(values)) == len(set(wanted)):
                        found.add((doc, item))
    return found


def test_op10_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = found(queries.op10_decontamination(spark, sf))
    assert len(got) > 5 and got == leaks_brute(docs, bench)


def test_slots_against_plain_templates(documents, spark):
    draw = random.Random(9)
    words = ["the", "In", "km", "5", "12", "Anna", "Bernd", "kg", "has", "of", "left", "7%", "h", "x"]
    line = lambda n: " ".join(draw.choice(words) for _ in range(n))
    bench = [(k, line(draw.randint(1, 14))) for k in range(60)]
    change = {"5": "8", "12": "30", "Anna": "Eva", "Bernd": "Otto", "km": "mi", "kg": "lb"}
    rows = []
    for k in range(150):
        held = bench[k % 60][1].split()
        if k % 2:
            held = [change.get(w, w) for w in held]
        rows.append((k, " ".join([line(draw.randint(0, 6)), *held, line(draw.randint(0, 6))])))
    got = found(decontaminate.leaks(documents(rows), items(spark, bench)))
    assert len(got) > 100 and got == leaks_brute(rows, bench)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("a", QUESTION), ("b", "clean")], "doc_id string, text string")
    bench = spark.createDataFrame([("q-1", QUESTION)], "item_id string, text string")
    assert found(decontaminate.leaks(docs, bench)) == {("a", "q-1")}


def test_windows_of_placeholders_are_found_verbatim(spark, documents):
    texts = ["John has 5 apples Mary has 7 pears", "Compute 12 + 15 * 3 - 7 / 2 + 9", "What Is The Capital Of France And Of Spain"]
    bench = items(spark, list(enumerate(texts)))
    rows = [(k, f"as in: {t}? and so on") for k, t in enumerate(texts)]
    rows += [(3, texts[2].lower()), (4, texts[0].replace("7", "8")), (5, texts[1].replace("15", "16").replace("7", "6")), (6, "Which Is The Capital Of Italy And Of Greece")]
    out = decontaminate.leaks(documents(rows), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in out} == {(0, 0), (1, 1), (2, 2), (3, 2)}
    assert all(r["coverage"] == 1 and not r["changed"] for r in out)


def test_short_units_after_numbers(spark, documents):
    trip = "the train went 120 km in 2 h and then stood still for a while before noon"
    bench = items(spark, [(1, trip), (2, "she bought 5 in nails and left for town at once with them today")])
    rows = [
        (1, trip.replace("120 km", "75 mi").replace("2 h", "3 h")),
        (2, trip.replace("120 km", "75mi").replace("2 h", "90min")),
        (3, trip.replace("120 km", "km 120")),
        (4, trip.replace("km", "h")),
        # a window that begins at a unit does not hang on the word before it
        (5, "pigs in nails and left for town at once with them here"),
        (6, "it rose 20 °C so we all went out to the lake"),
    ]
    out = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(documents(rows), bench).collect()}
    of_trip = 17 - decontaminate.WIDTH + 1
    assert {k for k, r in out.items() if r["coverage"] == 1} == {(1, 1), (2, 1)} and out[1, 1]["changed"] and out[1, 1]["n_windows"] == of_trip
    assert (4, 1) not in out or out[4, 1]["coverage"] < 1
    assert (5, 2) in out
    assert found(decontaminate.leaks(documents(rows), items(spark, [(3, "it rose 9°F so we all went out to the lake")]))) == {(6, 3)}
    words = "he is 5 in all at 5 km a day but 5% of 7 % is $5 or $ 5 °C 5 °C In 5 In".split()
    parts, template = decontaminate.all_parts(words), decontaminate.Templates()
    inside, alone, _ = template.hashes(words)
    hashed = lambda kind, value: decontaminate.word_hash(value if kind < 0 else f"<{decontaminate.TYPES[kind]}>")
    assert inside.tolist() == [hashed(i, v) for i, _, v in parts]
    assert alone.tolist() == [hashed(a, v) for _, a, v in parts]
    kinds = [(v, i) for i, _, v in parts]
    assert kinds[3:8] == [("in", 2), ("all", -1), ("at", -1), ("5", 0), ("km", 2)] and kinds[-1] == ("in", 2) and kinds[-3] == ("in", 1)
