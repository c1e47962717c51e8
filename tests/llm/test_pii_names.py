"""Names of any number of words after a title, and further mentions of them."""

import re

from symtrail.llm import pii

DOCS = "doc_id long, text string"


def test_whole_names_and_mentions(spark):
    rows = [
        (1, "KING spoke. Dr Martin Luther King came; King's wife and Martin Luther King left. Kingdom stays"),
        (2, "Dr. J. Smith met Prof. Dr. Ludwig van der Berg, and I saw John Smith. Berg and Smith ate"),
        (3, "Mr J.R.R. Tolkien. Tolkien wrote. Mrs. Anna O'Brien's dog; O'Brien, Anna"),
        (4, "Smith is no titled person here, a@b.com is"),
        (5, "Mr. John Smith and Dr. John Smith; Mr Smith I think"),
    ]
    got = {r["doc_id"]: r for r in pii.pseudonymised(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    text = {d: r["text"] for d, r in got.items()}
    one = re.match(r"(\w+) spoke\. Dr (\w+) (\w+) (\w+) came; (\w+)'s wife and (\w+) (\w+) (\w+) left\. Kingdom stays$", text[1])
    assert one and one[1] == one[4].upper() and one[5] == one[4] and one.group(6, 7, 8) == one.group(2, 3, 4) and got[1]["n_entities"] == 6
    assert not re.search("Martin|Luther|King(?!dom)|KING", text[1])
    two = re.match(r"Dr\. (\w+\.) (\w+) met Prof\. Dr\. (\w+) van der (\w+), and I saw John (\w+)\. (\w+) and (\w+) ate$", text[2])
    assert two and two[1] != "J." and two[2] == two[5] == two[7] and two[4] == two[6] and not re.search("Smith|Ludwig|Berg", text[2])
    three = re.match(r"Mr (\S+\.) (\w+)\. (\w+) wrote\. Mrs\. (\w+na) ([\w']+)'s dog; ([\w']+), (\w+)$", text[3])
    assert three and three[2] == three[3] and three[4] == three[7] and three[5] == three[6] and not re.search("Tolkien|J.R|Brien", text[3])
    assert text[4].startswith("Smith is no titled person here, ") and got[4]["kinds"] == ["email"]
    five = re.match(r"Mr\. (\w+) (\w+) and Dr\. (\w+) (\w+); Mr (\w+) I think$", text[5])
    assert five and five[1] == five[3] and five[2] == five[4] == five[5] == two[2]  # one person, and one surname everywhere
