"""What a worker holds parsed at a time doesn't grow with the batch that it is given."""

import pandas as pd

from strandline.sources import flatfile


def test_parsed_in_slices():
    lines = "".join(f"     gene            {i + 1}..{i + 9}\n" for i in range(1000))
    text = f"LOCUS       A 5000 bp    DNA     linear   BCT 01-JAN-2000\nFEATURES             Location/Qualifiers\n{lines}"
    given = pd.DataFrame({"path": "p", "record_index": range(1, 24), "text": text})
    sizes = [[len(x) for x in pdf["features"]] for pdf in flatfile._parser([], True)(iter([given]))]
    assert max(map(sum, sizes)) <= 5000 and sum(map(len, sizes)) == 23 and sum(map(sum, sizes)) == 23_000
