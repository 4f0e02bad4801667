"""Operators do the whole of what they name."""

from pathlib import Path

import numpy as np
from tokenizers import Tokenizer

from millrace.llm import decontam, licenses, token_records
from tests.llm.test_records_and_archives import WORD_BPE, odd_texts

NUMBERS = [
    "Compute 3 5 7 9 11 13 15 and then give the sum of these", "Find the mean 4 8 15 16 23 42 7 9 11 and round it up", "What is 17 + 25 * 3 - 14 / 2 + 99 - 6 * 31 + 8?", "12 + 30 = ?",
]


def test_decontamination_of_items_that_are_mostly_numbers(spark):
    items = spark.createDataFrame(list(enumerate(NUMBERS)), "item_id long, text string")
    docs = [(10 + i, f"Some words before it. {t} Some words after it.") for i, t in enumerate(NUMBERS)]
    docs += [(20 + i, t) for i, t in enumerate(NUMBERS)]
    docs += [(30, NUMBERS[0].replace("9", "4").replace("13", "62")), (31, NUMBERS[1].replace("42", "5"))]
    docs += [(40, "4 8 15 16 23"), (41, NUMBERS[2].replace("3", "5")), (42, "12 + 31 = ?"), (43, "Some words 1 2 3 4 5 6 7 8 9 and no more of them")]
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()
    copies = {(a + i, i): True for a in (10, 20) for i in range(len(NUMBERS))}
    assert {(r["doc_id"], r["item_id"]): r["verbatim"] for r in found} == copies | {(30, 0): False, (31, 1): False}
    assert {r["n_tokens"] for r in found if r["doc_id"] == 10} == {15}


def test_entire_license_texts(spark):
    files = sorted((Path(licenses.__file__).parent / "license_texts").glob("*.txt"))
    docs = [(i, f.read_text()) for i, f in enumerate(files)]
    docs += [(10 + i, f"Some prose.\n\n{t}\n\nmore of it\nand more") for i, t in docs]
    found = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["license"], r["unit"]): r["n"] for r in found if r["unit"] in ("document", "paragraphs")}
    assert len(files) == 7
    assert got == {(i, f.stem, "document"): 1 for i, f in enumerate(files)} | {(10 + i, f.stem, "paragraphs"): 1 for i, f in enumerate(files)}


def test_licenses_of_several_paragraphs_inside_documents(spark):
    known = dict(reversed(licenses.known_texts()))
    mit, bsd = known["MIT"], known["BSD-3-Clause"]
    docs = [
        (1, f"The MIT License\n\nCopyright (c) 2020 Some One\n\n{mit}\n\nint main() {{}}\n\nreturn"), (2, f"before\n\n{bsd}\n\nbetween\n\n{mit}\n\n{mit}"), (3, f"before\n\n{mit} and more\n\nafter"),
        (4, f"MIT License\n\n{mit}\n\nafter"), (5, f"before\n\n{' '.join(mit.split())}\n\nafter"),
    ]
    got = {(r["doc_id"], r["license"], r["unit"]): r["n"] for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {(1, "MIT", "paragraphs"): 1, (2, "BSD-3-Clause", "paragraphs"): 1, (2, "MIT", "paragraphs"): 2, (4, "MIT", "paragraphs"): 1, (5, "MIT", "paragraph"): 1}


def test_records_equal_an_untouched_tokenizer(spark):
    t = Tokenizer.from_file(WORD_BPE)
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x <|startoftext|> y", "<|EndOfText|> <|endoftext|>.", "plain words, here", *odd_texts(2000)]
    assert t.encode(texts[1], add_special_tokens=False).ids == [49407]
    manifest = token_records.write_records(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), WORD_BPE, 2)
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in token_records.read_records(manifest).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
