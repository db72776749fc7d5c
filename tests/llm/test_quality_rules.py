from patchwright.llm import quality_rules as Q


def test_lines_across_documents(spark):
    words = " ".join(f"w{k}" for k in range(60))
    shared = "All rights reserved by 2024 " + " ".join(f"s{k}" for k in range(80))
    rows = [(i, f"{shared}\n{' '.join(f'{chr(97 + i)}v{k}' for k in range(55))} {words}", "a") for i in range(12)]
    rows += [(100 + i, f"{shared.replace('2024', '1999')}\n t{i}", "a") for i in range(3)]
    rows += [(200, f"{shared}\n t", "b")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r for r in Q.apply_rules(df, min_docs=5).collect()}
    assert all(got[100 + i]["depleted"] and not got[100 + i]["kept"] for i in range(3))
    assert not got[200]["depleted"], "another host has its own count"
    assert all(got[i]["kept"] for i in range(12)) and got[0]["removed_chars"] == len(shared)


def test_repeated_rows_are_one_document(spark):
    text = " ".join(f"w{k}" for k in range(60))
    schema = "doc_id bigint, text string, source string"
    assert all(r["kept"] for r in Q.apply_rules(spark.createDataFrame([(1, text, "a")] * 30, schema)).collect())
    assert not any(r["kept"] for r in Q.apply_rules(spark.createDataFrame([(i, text, "a") for i in range(6)], schema)).collect())


def test_low_limits_on_small_and_hot_hosts(spark):
    own = lambda i: " ".join(f"d{chr(97 + i % 26)}{chr(97 + i // 26)}w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(i, f"small host footer\n{own(i)}", "small") for i in range(8)]
    rows += [(100 + i, f"rare header\n{own(100 + i)}" if i < 8 else own(100 + i), "hot") for i in range(400)]
    rows += [(600 + i, f"wide notice\n{own(600 + i)}", f"host{i}") for i in range(24)]
    rows += [(700 + i, f"mass copy line\n{own(700)}", "copies") for i in range(8)]
    rows += [(800 + i, f"said four times\n{own(800 + i)}", "few") for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r["doc_id"]: r["removed_chars"] for r in Q.apply_rules(df).collect()}
    assert all(got[i] == len("small host footer") for i in range(8))
    assert all(got[100 + i] == (len("rare header") if i < 8 else 0) for i in range(400))
    assert all(got[600 + i] == len("wide notice") for i in range(24))
    assert all(got[700 + i] == len("mass copy line") + len(own(700)) for i in range(8))
    assert all(got[800 + i] == 0 for i in range(4))


def test_lines_are_removed_from_the_text(spark):
    rows = [(i, f"Menu 2{i}\r\n\n first {i}x{chr(97 + i)}\nsame {i}\n\nlast {chr(97 + i)} y\n menu 77", "a") for i in range(8)]
    rows += [(50, "alone\nand whole\n", "b"), (51, None, "a"), (52, "", "a"), (53, "menu 11", "a"), (0, rows[0][1], "a")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = Q.apply_rules(df, min_docs=5, min_left=0.4).collect()
    text = {r["doc_id"]: r["text"] for r in got}
    assert len(got) == len(rows)
    assert all(text[i] == f"\n first {i}x{chr(97 + i)}\n\nlast {chr(97 + i)} y" for i in range(8))
    assert (text[50], text[51], text[52], text[53]) == ("alone\nand whole\n", None, "", "")
    for r in got:
        assert r["line_chars"] - r["removed_chars"] == sum(len(x.strip(" \t\x0b\x0c\r")) for x in (r["text"] or "").split("\n"))


def test_the_method_decides_on_the_real_rows(spark, small):
    """Lines go that the base rules would leave, and most documents stay."""
    rows = Q.op6(spark, small).collect()
    assert sum(r["removed_chars"] > 0 for r in rows) > 20
    assert sum(r["kept"] for r in rows) > 0.5 * len(rows)


def test_edge_cases(spark, odd):
    rows = Q.apply_rules(odd).collect()
    assert len(rows) == 9 and sum(r["kept"] for r in rows) == 1
    long = next(r for r in rows if r["doc_id"] == 4)
    assert long["n_words"] == 30000 and long["n_repeat_words"] == 0 and long["kept"]
    assert Q.apply_rules(odd.limit(0)).count() == 0
    rep = spark.createDataFrame([(1, "a b c x a b c a b c", None), (2, "a a a a", "s")], "doc_id bigint, text string, source string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in Q.apply_rules(rep).collect()} == {1: 9, 2: 4}
