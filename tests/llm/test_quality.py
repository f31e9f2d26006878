import glob

import pyarrow.parquet as pq
import pytest

from quillmesh.llm.quality import jensen_shannon, statistics, text_statistics

PROSE = "The harbour was measured twice by the team, and once it had dried the farmers said that they would not use it again. "
CASES = {
    "prose": [
        PROSE * 1, PROSE.replace(" ", "\n", 8), "Der Bericht wurde im Jahr 2020 von den Gemeinden geprüft und ist nicht mehr in der Liste zu finden. ",
        "किसानों ने कहा कि नहर और जल के बिना खेती कठिन है। इस नई अध्ययन में परिवारों से मौसम के बारे में पूछा गया।",
        PROSE + "\n" + "-" * 200 + "\n" + PROSE, "> " + PROSE.replace(", ", ",\n> "), PROSE.upper(), "Short title", PROSE * 2 + "\n\n- one\n- two\n- three",
        "The first point is that we have been asked to do it.\nThe second is that it was done in May.\nAnd there is a third which they left out.",
    ],
    "list": [
        "- red valve\n- old pump\n- blue pipe\n- dry well", "1. Pump\n2) Valve\n3. Pipe", "Oslo, trade\nLima, water\nRome housing\nBonn, energy",
        "Pumps ........ 3\nValves ............ 14\nPipes ..... 20", "Pump: small valve for water\nDrill: big hammer for stone\nSaw: thin blade for wood",
        "Abel, N. (2012). Dry wells in Oslo. J. Water Stud. 31(5): 59-86.\nBaker, C. (2008). Old pumps. J. Trade Stud. 2(1): 9-16.", "• one\n\n• two\n\n• three\n\n• four",
    ],
    "table": [
        "| a | b |\n|---|---|\n| Oslo | 3 |\n| Lima | n/a |", "City,Pumps,Wells\nOslo,3,4.5\nLima,,12\nRome,7,-", "City\tPumps\nOslo\t3\nLima\t12,000\nRome\t-",
        "City;Pumps;Wells\nOslo;3,000;4.5\nLima;-;12", "City       Pumps     Wells\nOslo       3         4.5\nLima       12        -\nRome                 9",
    ],
    "junk": [
        "pump, " * 30, "x9$%{}|~^&*<>[]" * 10, "aB3dE5fG7hJ9kL1mN3pQ5rS7tU9vW1xY3z/" * 6, "valve reduced energy harbour reviewed trustees pump glass restored water canal steel humid gauge",
        PROSE * 12, "var a=function(d){return f[17]||{p:'b1f4af53'};}\nvar b=function(c){return f[60]||{i:'7da4812e'};}\nvar c=function(c){return g[19]||{p:'aaf68f95'};}",
        "kjh wrt;x | zzvx 1kk fdl: m bn xcv,d | qrt lkj hgf : mnb vcx z1 pqw;r tyu lkx", "old pump\n" * 12,
    ],
}


@pytest.mark.parametrize("kind,text", [(k, t) for k, ts in CASES.items() for t in ts])
def test_kinds(kind, text):
    assert statistics(text)["kind"] == kind


def test_blank_texts_and_columns(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, " \n\t", "b"), (3, PROSE, "c"), (3, PROSE, "c")], "id int, text string, kind string")
    got = text_statistics(df).orderBy("id").collect()
    assert [r.kind for r in got] == [None, None, "prose", "prose"] and got[0].words is None
    assert got[2].words == 23 and got[2].punctuated_lines == 1.0 and got[2].nearest_language == "en"
    assert text_statistics(df.limit(0)).count() == 0


def test_long_text_is_read_whole():
    assert statistics("- dry well number\n" + "\n".join(f"- pumping station {i}" for i in range(50_000)))["kind"] == "list"
    assert statistics(PROSE + "\n\n" + "\n".join(f"| {i} | {i * 3} | n/a |" for i in range(3_000)))["kind"] == "table"


def test_divergence():
    assert jensen_shannon([1, 0], [1, 0]) == 0 and jensen_shannon([1, 0], [0, 1]) == 1


def test_labelled_documents():
    """Labelled documents of the two smallest scales. They were read when the layouts were designed, so this is no held-out accuracy."""
    right = n = 0
    for sf in ("sf0.001", "sf0.01"):
        if not glob.glob(f"/root/testdata/{sf}/doc_labels.parquet"):
            pytest.skip("no labelled documents here")
        texts = dict(zip(*(c.to_pylist() for c in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["doc_id", "text"]).columns)))
        for r in pq.read_table(f"/root/testdata/{sf}/doc_labels.parquet").to_pylist():
            got = statistics(texts[r["doc_id"]])
            right += (got["kind"] if got else "prose") == r["kind"]
            n += 1
    assert right / n >= 0.97
