"""Children of the roots of XML files, cut by many tasks, against a plain parser."""

import random
from xml.etree import ElementTree

import pytest

from quillgraph.sources.splitting import root_children

HEAD = '<?xml version="1.0"?>\n<!DOCTYPE r [\n <!ENTITY e "entity > text">\n <!ENTITY f "x">\n]>\n<!-- before > the <root> -->\n<n:r xmlns:n="urn:n" xmlns="urn:d" a="1">'


def document(n, seed):
    rng, out = random.Random(seed), [HEAD]
    for i in range(n):
        kind = rng.randrange(6)
        out.append(rng.choice(["", "\n  ", " text > here ", "<!-- <Class> between -->", "<?pi x?>"]))
        out.append(
            [f'<Class id="{i}"><sub n:k="v">a &e; > b</sub><Class/></Class>', f'<n:Empty id="{i}"/>', f'<Prop id="{i}"><![CDATA[ <not> a ]] tag > ]]></Prop>', f'<Deep id="{i}">{"<d>" * 30}é{"</d>" * 30}</Deep>', f'<Line id="{i}">\n one\n two <!-- a > <b> --> three\n</Line>', f'<Class id="{i}" />'][kind]
        )
    return "".join(out) + "\n</n:r>\n<!-- after -->\n"



def split(spark, path):
    out = {}
    for r in root_children(spark, path).collect():
        (child,) = ElementTree.fromstring(r.xml)
        child.tail = None
        out.setdefault(r.file.rpartition("/")[2], {})[r.record] = ElementTree.canonicalize(ElementTree.tostring(child, encoding="unicode"), strip_text=True)
    return out


def test_children_of_several_files_in_small_splits(spark, tmp_path):
    texts = {f"f{i}.xml": document(n, i) for i, n in enumerate((120, 1, 0, 60))}
    for name, text in texts.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = split(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    for name, text in texts.items():
        want = []
        for c in ElementTree.fromstring(text):
            c.tail = None
            want.append(ElementTree.canonicalize(ElementTree.tostring(c, encoding="unicode"), strip_text=True))
        assert [v for _, v in sorted(found.get(name, {}).items())] == want and sorted(found.get(name, {})) == list(range(1, len(want) + 1))


def test_files_that_are_not_well_formed(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<r><a></r>")
    with pytest.raises(ValueError, match="x.xml"):
        root_children(spark, str(tmp_path / "x.xml"))
