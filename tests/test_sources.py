import random

import pytest

from strandlake.functions import runs as R
from strandlake.plans import convert
from strandlake.sources import files, records, transforms


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x 1\nACGT\n>y\nNNCC\n")
    (tmp_path / "b.fq").write_text("@x\nACGT\n+\nIIII\n@y\nACNN\n+y\n!!##\n")
    (tmp_path / "c.seq").write_text("ACGT\nTTTT\n\n")
    as_rows = lambda df: [tuple(r) for r in df.orderBy("seq_id").collect()]
    assert as_rows(convert.read(spark, str(tmp_path / "a.fa"))) == [(0, "x 1", "ACGT", None), (1, "y", "NNCC", None)]
    assert as_rows(convert.read(spark, str(tmp_path / "b.fq"))) == [(0, "x", "ACGT", "IIII"), (1, "y", "ACNN", "!!##")]
    assert as_rows(convert.read(spark, str(tmp_path / "c.seq"))) == [(0, None, "ACGT", None), (1, None, "TTTT", None)]
    assert files.checked(files.fasta(spark, str(tmp_path / "a.fa"))).count() == 2
    (tmp_path / "odd.fa").write_text(">x\nACGT\n>y\nACG\n")
    with pytest.raises(Exception, match="another length"):
        files.checked(files.fasta(spark, str(tmp_path / "odd.fa"))).collect()


@pytest.mark.parametrize(("path", "start", "kind"), [("a.fa", None, "fasta"), ("x/A.FASTQ.gz", None, "fastq"), ("d/cyc.3", None, "cyc"), ("reads", ">x", "fasta"), ("reads", "@x", "fastq"), ("reads", "acgt", "seq")])
def test_sniffing(path, start, kind):
    assert files.format_of(path, start) == kind


def test_unknown_formats():
    with pytest.raises(ValueError):
        files.format_of("reads", "?")
    for a, b in (("fasta", "bcl"), ("bwt_rle53", "bwt_ascii"), ("seq", "seq")):
        with pytest.raises(ValueError):
            convert.legal(a, b)
    with pytest.raises(ValueError):
        convert.legal("seq", "cyc", length=30)


def test_conversion_round_trip(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("".join(f"@r{k}\n{'ACGTN' * 3}\n+\n{'IHG#!' * 3}\n" for k in range(6)))
    convert.convert(spark, str(tmp_path / "a.fastq"), str(tmp_path / "a.fasta"), "fasta")
    convert.convert(spark, str(tmp_path / "a.fasta"), str(tmp_path / "b.fastq"), "fastq", kind="fasta", missing_from=str(tmp_path / "a.fastq"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "b.fastq").glob("part-*")))
    assert text == (tmp_path / "a.fastq").read_text()
    convert.convert(spark, str(tmp_path / "a.fastq"), str(tmp_path / "c.fasta"), "fasta", length=4, ids=spark.range(2, 4).withColumnRenamed("id", "seq_id"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "c.fasta").glob("part-*"))) == ">r2\nACGT\n>r3\nACGT\n"


def test_cycles(spark, tmp_path):
    reads = ["ACGT", "TTTT", "NNAA"]
    for c in range(4):
        (tmp_path / f"cyc.{c}").write_bytes("".join(r[c] for r in reads).encode())
        (tmp_path / f"qual.cyc.{c}").write_bytes(bytes([33 + c, 40, 41]))
    rows = files.cycles(spark, str(tmp_path / "cyc"))
    got = files.from_cycles(rows).orderBy("seq_id").collect()
    assert [(r.bases, r.quals) for r in got] == [("ACGT", '!"#$'), ("TTTT", "(((("), ("NNAA", "))))")]


def test_base_calls(spark, tmp_path):
    (tmp_path / "t1.bcl").write_bytes((4).to_bytes(4, "little") + bytes([0, 4 * 10 + 1, 4 * 20 + 2, 4 * 30 + 3]))
    (tmp_path / "t1.filter").write_bytes(bytes(12) + bytes([1, 0, 1]))
    got = files.base_calls(spark, str(tmp_path / "t1.bcl"), str(tmp_path / "t1.filter")).orderBy("cluster").collect()
    assert [(r.cluster, r.base, r.qual) for r in got] == [(0, "N", "!"), (2, "G", "5"), (3, "T", "?")]


def test_run_folder(spark, tmp_path):
    for c in (1, 2):
        p = tmp_path / "Data/Intensities/BaseCalls/L001" / f"C{c}.1"
        p.mkdir(parents=True)
        for tile in ("s_1_1101", "s_1_1102"):
            (p / f"{tile}.bcl").write_bytes((2).to_bytes(4, "little") + bytes([4 * 30 + c, 4 * 30]))
    assert files.run_folder(spark, str(tmp_path)).count() == 8


def test_run_length_files(spark, tmp_path):
    runs = [("A", 5), ("C", 59), ("$", 1), ("T", 100_000)]
    (tmp_path / "x-B01").write_bytes(R.v3_file(runs))
    (tmp_path / "y-B01").write_bytes(bytes([1 | 4 << 4, 0]))
    (tmp_path / "z-B01").write_text("AAC$")
    got = files.run_length(spark, str(tmp_path / "x-B01")).orderBy("run_no").collect()
    assert [(r.ch, r.run) for r in got] == runs
    assert [(r.ch, r.run) for r in files.run_length(spark, str(tmp_path / "y-B01"), "nibble").orderBy("run_no").collect()] == [("A", 5), ("$", 1)]
    assert [r.ch for r in files.ascii_transform(spark, str(tmp_path / "z-B01")).orderBy("rank").collect()] == list("AAC$")


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_side_files(spark, tmp_path):
    assert [r[0] for r in files.kmers(lines(spark, "ACGT # 25 results", "", " CC x")).collect()] == ["ACGT", "CC"]
    with pytest.raises(Exception, match="one letter"):
        files.kmers(lines(spark, "A")).collect()
    assert sorted(r[0] for r in files.numbers(lines(spark, "3 x", "1", "3", "z")).collect()) == [1, 3]
    assert [tuple(r) for r in files.intervals(lines(spark, "ACGT  5 2")).collect()] == [("ACGT", 5, 2)]
    assert [tuple(r) for r in files.scientific_names(lines(spark, "1\t|\troot\t|\t\t|\tscientific name\t|", "1\t|\tall\t|\t\t|\tsynonym\t|")).collect()] == [(1, "root")]
    assert [tuple(r) for r in files.tax_nodes(lines(spark, "2\t|\t1\t|\tspecies\t|\tx\t|")).collect()] == [(2, 1, "species")]
    assert sorted(tuple(r) for r in files.tax_paths(lines(spark, "# no", "", "0 5 0 7")).collect()) == [(0, 0, 5), (0, 1, 0), (0, 2, 7)]
    assert [tuple(r) for r in files.normalisation(lines(spark, "FINAL: g 9 5 20 Counts: 9:4", "other")).collect()] == [(9, 9, 4, 20)]


def test_corrections_file(spark, tmp_path):
    schema = "seq_id bigint, position int, reverse_strand int, corrector string, corrector_start int, shortest_witness int, longest_witness int"
    rows = spark.createDataFrame([(1, 5, 0, "ACG", 3, 8, 9)], schema)
    files.write_corrections(rows, str(tmp_path / "c"))
    assert files.corrections(spark, str(tmp_path / "c")).collect() == rows.collect()


def plain_records(texts, per):
    out = []
    for t in texts:
        x = t.splitlines()
        while x and not x[-1]:
            x.pop()
        out += [tuple(x[i : i + per]) for i in range(0, len(x), per)]
    return out


@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_records_of_split_files(spark, tmp_path, size):
    """Ranges of a few letters up to whole files, with qualities that begin like names, empty reads and empty lines at ends."""
    r = random.Random(size)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    fastq, fasta, seq = [], [], []
    for f in range(3):
        sizes = [r.choice([0, 1, 3, 30, 100]) for _ in range(r.randint(1, 12))]
        fastq.append("".join(f"@n{f}.{k}\n{word('ACGT', n)}\n+\n{word('@+I#', n)}\n" for k, n in enumerate(sizes)) + "\n" * f)
        fasta.append("".join(f">n{f}.{k} x\n{word('ACGTN', n)}\n" for k, n in enumerate(sizes)) + "\n" * f)
        seq.append("".join(f"{word('ACGT', n)}\n" for n in sizes))
    fastq[1] = fastq[1].rstrip("\n")  # no line feed at the end
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        for kind, texts, per in (("fastq", fastq, 4), ("fasta", fasta, 2), ("seq", seq, 1)):
            folder = tmp_path / kind
            folder.mkdir()
            for k, t in enumerate(texts):
                (folder / f"{k}.{kind}").write_text(t)
            want = [x for x in plain_records(texts, per) if per > 1 or x[0]]
            df = records.read(spark, str(folder), kind)
            rows = sorted(tuple(x) for x in df.collect())
            assert [x[0] for x in rows] == list(range(len(want)))
            assert [tuple(y or "" for y in x[1:]) for x in rows] == [x + ("",) * (per - len(x)) for x in want]
            if size == 40:
                assert records.lines(spark, str(folder)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_records_out_of_step(spark, tmp_path):
    (tmp_path / "odd.fa").write_text(">a\nAC\nGT\n>b\nACGT\n")
    with pytest.raises(Exception, match="out of step"):
        records.read(spark, str(tmp_path / "odd.fa"), "fasta").collect()


def test_compressed_records(spark, tmp_path):
    import gzip

    (tmp_path / "a.fq.gz").write_bytes(gzip.compress(b"@a\nAC\n+\n@+\n@b\nGT\n+\nII\n"))
    assert sorted(tuple(x) for x in files.fastq(spark, str(tmp_path / "a.fq.gz")).collect()) == [(0, "a", "AC", "@+"), (1, "b", "GT", "II")]


def test_runs_are_written_and_read(spark, tmp_path):
    """Two tiles, a filter for one of them, reads of several lengths, and bytes of every kind, line feeds too."""
    r = random.Random(3)
    reads = [("".join(r.choice("ACGTN") for _ in range(n)), "".join(chr(33 + r.randrange(41)) for _ in range(n))) for n in (5, 3, 5, 4, 5, 5, 1)]
    df = spark.createDataFrame([(k, b, q) for k, (b, q) in enumerate(reads)], "seq_id bigint, bases string, quals string")
    files.write_run(files.to_cycles(df), str(tmp_path), 4)
    top = tmp_path / "Data" / "Intensities" / "BaseCalls" / "L001"
    assert sorted(f"{p.parent.name}/{p.name}" for p in top.glob("*/*.bcl")) == sorted(f"C{c}.1/s_1_{t}.bcl" for c in range(1, 6) for t in (0, 1))
    want = {k: ("".join("N" if q == "!" or b == "N" else b for b, q in zip(*x, strict=True)), "".join("!" if b == "N" else q for b, q in zip(*x, strict=True))) for k, x in enumerate(reads)}
    shown = lambda: {int(x.tile[-1]) * 4 + x.cluster: (x.bases.rstrip("N"), x.quals) for x in files.from_run(files.run_folder(spark, str(tmp_path))).collect()}
    got = shown()
    assert set(got) == set(want) and all(got[k][0] == want[k][0].rstrip("N") and got[k][1].startswith(want[k][1]) for k in want)
    (top / "s_1_0.filter").write_bytes(bytes(12) + bytes([1, 0, 1]))
    assert set(shown()) == set(want) - {1}


RUNS = [("$", [("A", 3), ("C", 70000), ("A", 1)]), ("A", [("G", 58), ("T", 59), ("N", 5), ("$", 17), ("N", 1), ("A", 928), ("C", 929)]), ("T", [("T", 10**6)])]


@pytest.mark.parametrize("kind", transforms.KINDS)
def test_transform_files(spark, tmp_path, kind):
    """What is written is read, with splits of any size, and equals the plain codes of a file."""
    rows = []
    for pile, each in RUNS:
        at = 0
        for ch, n in each:
            for part in (n // 3, n - n // 3):  # the sink takes runs that go on
                if part:
                    rows.append((pile, at, ch, part, "x"))
                    at += part
    df = spark.createDataFrame(rows, "pile string, first bigint, ch string, run bigint, `a.b` string")
    transforms.write(df, str(tmp_path / "x"), kind)
    told = None if kind in ("ascii", "nibble", "v3") else kind
    for split in {"v3": (1, 7, 1 << 20), "ascii": (200_000, 1 << 20)}.get(kind, (9_999, 1 << 20)):
        got = transforms.read(spark, f"file:{tmp_path}/x", told, split).orderBy("pile", "first").collect()
        assert {r.kind for r in got} == {kind}
        for pile, each in RUNS:
            text = "".join(c * n for c, n in each)
            mine = [r for r in got if r.pile == pile]
            assert "".join(r.ch * r.run for r in mine) == text
            assert [r.first for r in mine] == [sum(r.run for r in mine[:k]) for k in range(len(mine))] or len(mine) > 2000
    with pytest.raises(Exception, match="FileExistsError"):
        transforms.write(df, str(tmp_path / "x"), kind)
    whole = transforms.concatenated(transforms.read(spark, str(tmp_path / "x"), told))
    assert whole.agg({"first": "max"}).first()[0] < sum(n for _, each in RUNS for _, n in each)


def test_codes_equal_plain_ones():
    import numpy as np

    r = random.Random(3)
    for _ in range(50):
        each, last = [], None
        for _ in range(r.randint(0, 30)):
            last = r.choice([c for c in "$ACGNT" if c != last])
            each.append((last, r.choice((1, 2, 4, 5, 16, 17, 58, 59, 63, 64, 65, 928, 929, 10**6))))
        letter, run = np.array(["$ACGNT".index(c) for c, _ in each], np.uint8), np.array([n for _, n in each], np.int64)
        v3 = transforms.v3_head() + transforms.coded(letter, run, "v3")
        assert v3 == R.v3_file(each) and R.v3_parsed(v3) == each
        for kind in transforms.KINDS:
            head = v3 if kind == "v3" else b""
            data = np.frombuffer(transforms.coded(letter, run, kind), np.uint8)
            a, b = transforms.decoded(data, transforms.table_of(kind, head))
            assert [("$ACGNT"[x], int(n)) for x, n in zip(a, b, strict=True)] == each


def test_transform_files_that_are_damaged(spark, tmp_path):
    for name, data in (("empty-B00", b""), ("v3-B00", R.V3_HEADER + b"A"), ("nibble-B01", b"\x0f" * 9)):
        (tmp_path / name).write_bytes(data)
    assert transforms.read(spark, str(tmp_path / "empty-B00")).count() == 0
    for name in ("v3-B00", "nibble-B01", "absent"):
        with pytest.raises(Exception, match="damaged|means no letter|FileNotFound"):
            transforms.read(spark, str(tmp_path / name)).collect()
    (tmp_path / "ok-B03").write_bytes(b"acgt$N")
    assert [(r.pile, r.kind, r.first, r.ch, r.run) for r in transforms.read(spark, str(tmp_path / "ok-B03")).orderBy("first").collect()] == [("G", "ascii", k, c, 1) for k, c in enumerate("ACGT$N")]
    none = spark.createDataFrame([], "pile string, first bigint, ch string, run bigint")
    transforms.write(none, str(tmp_path / "none"))
    assert not (tmp_path / "none").exists() or transforms.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="alphabet"):
        transforms.write(spark.createDataFrame([("A", 0, "x", 1)], none.schema), str(tmp_path / "bad"))


def test_coded_files_shuffle_no_single_runs(spark, tmp_path):
    """The sink sorts stretches of codes and the source shuffles no run; runs out of order and long ones come back."""
    from strandlake.operators.storage import stored
    from test_reads import shuffled

    letters = "".join("ACGNT$"[k * k % 7 % 6] for k in range(20000))
    rows = stored(spark.createDataFrame([("A", k, c, 1) for k, c in enumerate(letters)] + [("C", 7, "G", 3), ("C", 0, "T", 7)], "pile string, first bigint, ch string, run bigint").coalesce(2))

    def made():
        transforms.write(rows, str(tmp_path / "out"), "v3")
        return transforms.read(spark, str(tmp_path / "out"))

    found, moved = shuffled(spark, made)
    assert moved < 2000
    assert "".join(r.ch * r.run for r in sorted(found, key=lambda r: r.first) if r.pile == "A") == letters
    assert sorted((r.first, r.ch, r.run) for r in found if r.pile == "C") == [(0, "T", 7), (7, "G", 3)]


def test_cycles_are_joined_before_the_shuffle(spark):
    from test_reads import shuffled

    pick = random.Random(2)
    rows = [(k, "".join(pick.choice("ACGTN") for _ in range(k % 700)), "".join(chr(33 + pick.randrange(40)) for _ in range(k % 700))) for k in range(300)]
    reads = spark.createDataFrame(rows, "seq_id bigint, bases string, quals string").coalesce(2)
    found, moved = shuffled(spark, lambda: files.from_cycles(files.to_cycles(reads)), "shuffleWriteBytes")
    assert moved < 3 * sum(len(r[1]) for r in rows)
    assert sorted((r.seq_id, r.bases, r.quals) for r in found) == [r for r in rows if r[1]]
    mixed = files.from_cycles(files.to_cycles(reads).orderBy("cycle", "seq_id"))
    assert sorted((r.seq_id, r.bases, r.quals) for r in mixed.collect()) == [r for r in rows if r[1]]
