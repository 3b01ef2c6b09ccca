import io
import os
import zipfile

from domscope.sources import archives
from domscope.sources.daily import MEMBER


def packed(**members):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/").replace("_zip", ".zip").replace("list", MEMBER), content)
    return data.getvalue()


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_traverse(spark, tmp_path, monkeypatch):
    root, cache = f"{tmp_path}/top", f"file://{tmp_path}/cache"
    plain = packed(list="a-b.com\n\n  B.org \r\nB.org")
    deep = packed(in__inner_zip=packed(x_zip=packed(list="deep.net"), list="mid.net"), note="no list")
    put(f"{root}/1.zip", plain)
    put(f"{root}/sub/copy.zip", plain)
    put(f"{root}/sub/deep.zip", deep)
    put(f"{root}/open/{MEMBER}", b"open.io\n\xff\xfeodd\n")
    put(f"{root}/other.txt", b"not.read")
    put(f"{root}/empty.zip", packed(note=""))
    put(f"{root}/broken.zip", b"PK no zip")
    read = []
    made = archives.domains
    monkeypatch.setattr(archives, "domains", lambda a: read.append(sorted(os.path.basename(r.path) for r in a.collect())) or made(a))
    rows = lambda df: sorted((os.path.relpath(r.path.removeprefix("file:"), root), r.domain, r.hyphens) for r in df.collect())
    want = [("1.zip", "B.org", 0.0), ("1.zip", "B.org", 0.0), ("1.zip", "a-b.com", 1.0), ("open/dailyupdate.txt", "odd", 0.0), ("open/dailyupdate.txt", "open.io", 0.0)]
    want += [("sub/copy.zip", d, h) for _, d, h in want[:3]] + [("sub/deep.zip", "deep.net", 0.0), ("sub/deep.zip", "mid.net", 0.0)]
    assert rows(archives.traverse(spark, f"file://{root}", cache)) == want and len(read[0]) == 5  # of two copies one
    put(f"{root}/new.zip", packed(list="new.com"))
    os.rename(f"{root}/1.zip", f"{root}/2.zip")
    again = rows(archives.traverse(spark, f"file://{root}", cache))
    assert read[1:] == [["new.zip"]]
    assert again == sorted([("2.zip" if p == "1.zip" else p, d, h) for p, d, h in want] + [("new.zip", "new.com", 0.0)])
    assert rows(archives.traverse(spark, f"file://{root}", cache)) == again and len(read) == 2


def test_long_lists_come_in_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "LINES", 100)
    put(f"{tmp_path}/a/x.zip", packed(list="\n".join(f"d{k}.com" for k in range(1050))))
    there = archives.found(spark, f"file://{tmp_path}/a")
    assert archives.domains(there).select("domain").distinct().count() == 1050
