"""Blocks and chunks of Markdown: nothing lost, nothing whole cut, headings right."""

import re

import numpy as np
import pytest

from tessella import catalogue
from tessella.functions import markdown
from tessella.plans import language

DIR = "/root/testdata/sf0.001"

TEXT = """# One
intro line
goes on

| a | b |
|---|:-:|
| 1 | 2 |
after the table
## Two
```python
# no heading
x = "|"

```
- item
  continued

  - nested

    deep
- second
plain
> quote
> more
$$
x | y
$$
### Three
~~~~
```
~~~
~~~~
<table><tr>
<td>1</td></tr></table>
1. first
2) second
## Four
```
never closed
# still code"""


def test_blocks():
    got = [(b.kind, len(b.lines), b.headings) for b in markdown.blocks(TEXT)]
    one, two, three = ("# One",), ("# One", "## Two"), ("# One", "## Two", "### Three")
    want = [("heading", 1, ()), ("paragraph", 2, one), ("table", 3, one), ("paragraph", 1, one), ("heading", 1, one), ("fence", 5, two), ("list", 8, two), ("quote", 2, two), ("formula", 3, two), ("heading", 1, two)]
    want += [("fence", 4, three), ("table", 2, three), ("list", 2, three), ("heading", 1, one), ("fence", 3, ("# One", "## Four"))]
    assert [g for g in got] == want


def test_no_line_is_lost():
    assert [x for b in markdown.blocks(TEXT) for x in b.lines if x.strip()] == [x for x in TEXT.split("\n") if x.strip()]
    assert markdown.blocks("") == markdown.blocks("\n \n") == []


@pytest.mark.parametrize("least,most,level", [(1, 10, 6), (20, 40, 2), (5, 1000, 1)])
def test_chunks_of_random_texts(least, most, level):
    rng = np.random.default_rng(most)
    parts = ["# h{}", "## h{}", "### h{}", "```\na {}\n\nb\n```", "| a{} | b |\n|---|---|\n| c | d |", "- i{}\n  - j", "> q{}", "$$\nf{}\n$$", "word{} " * 15 + ".", "one{} two. three four!"]
    for _ in range(60):
        text = "\n\n".join(parts[int(k)].replace("{}", str(n)) for n, k in enumerate(rng.integers(0, len(parts), rng.integers(1, 25))))
        made = markdown.chunks(text, least, most, level)
        squeeze = lambda s: re.sub(r"\s+", "", s)
        assert squeeze("".join(c for _, c in made)) == squeeze(text)
        whole = [b.text for b in markdown.blocks(text) if b.kind in markdown.WHOLE]
        assert all(any(w in c for _, c in made) for w in whole)
        for k, (path, c) in enumerate(made):
            rest = [x for x in markdown.blocks(c) if x.kind != "heading"]
            assert markdown.size(c) <= most or len(rest) == 1
            if k and markdown.blocks(c)[0].kind != "heading":
                first = c.split("\n")[0]
                if text.count(first) == 1:
                    assert path == " > ".join(h.lstrip("# ") for h in next(b.headings for b in markdown.blocks(text) if first in b.text))


def test_missing_parent_headings_are_put_in():
    text = "# A\n## B\n" + "word " * 30 + "\n### C\n" + "more " * 30
    made = markdown.chunks(text, 10, 40, parents=True)
    assert made[1][0] == "A > B" and made[1][1].split("\n")[:3] == ["# A", "## B", "### C"]


def test_long_paragraphs_are_cut_at_sentences():
    text = "One two three. Four five six! Seven eight nine? Ten."
    assert [c for _, c in markdown.chunks(text, 1, 8)] == ["One two three. Four five six! ", "Seven eight nine? Ten."]
    assert all(markdown.size(c) <= 5 for _, c in markdown.chunks("w " * 100, 1, 5))


def test_queries_over_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in language.markdown_documents(spark, DIR).collect()}
    rows = catalogue.queries()["markdown_chunks"](spark, DIR).collect()
    kinds = {r["kind"] for r in catalogue.queries()["markdown_blocks"](spark, DIR).collect()}
    assert kinds == {"heading", "fence", "table", "list", "quote", "paragraph"}
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r["content"])
    assert by.keys() == docs.keys()
    for d, text in docs.items():
        for b in markdown.blocks(text):
            assert b.kind not in markdown.WHOLE or any(b.text in c for c in by[d])
