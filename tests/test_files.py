"""Files in and out: manifests, FASTA, FASTQ, pairs, the commands, and a stream."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from readsift.config import ClassifySettings, DehostSettings, IndexSettings
from readsift.functions import columns as C
from readsift.operators import sinks
from readsift.plans import cli, pipeline
from readsift.sources.manifest import read_manifest
from readsift.sources.sequences import pair, read_fasta, read_fastq, read_sequences
from readsift.streaming.classify import call_stream


def dna(seed, n):
    r = random.Random(seed)
    return "".join(r.choice("ACGT") for _ in range(n))


def fastq(path, records, pack=False):
    text = "".join(f"@{i}\n{s}\n+\n{q}\n" for i, s, q in records)
    with (gzip.open(path, "wt") if pack else open(path, "w")) as f:
        f.write(text)
    return str(path)


def fasta(path, records, width=70):
    with open(path, "w") as f:
        for i, s in records:
            f.write(f">{i}\n" + "".join(s[a : a + width] + "\n" for a in range(0, len(s), width)))
    return str(path)


def test_manifest(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("b.fa\thost\n\nlonely\na.fa\tother thing\textra\nc.fa\thost\r\n")
    rows = read_manifest(spark, str(path)).orderBy("bin").collect()
    assert [(r.bin, r.path.split("/")[-1], r.category, r.category_idx) for r in rows] == [(0, "b.fa", "host", 0), (1, "a.fa", "other thing", 1), (2, "c.fa", "host", 0)]
    assert rows[0].path.startswith("/")
    path.write_text("".join(f"f{i}\tc\n" for i in range(255)))
    assert read_manifest(spark, str(path)).count() == 255
    for text in ("".join(f"f{i}\tc\n" for i in range(256)), "\n"):
        path.write_text(text)
        with pytest.raises(ValueError):
            read_manifest(spark, str(path))


def test_fasta(spark, tmp_path):
    records = [(f"KX{i}.1 a name > with more", dna(i, 50 + 71 * i)) for i in range(6)] + [("lower", "acgunryk")]
    path = fasta(tmp_path / "x.fasta", records)
    rows = read_fasta(spark, path).orderBy("read_ord").collect()
    assert [(r.id, r.header, r.seq) for r in rows[:6]] == [(i.split(" ")[0], i, s) for i, s in records[:6]]
    assert rows[6].seq == "ACGTNNNN" and rows[6].qual is None


@pytest.mark.parametrize("pack", [False, True])
def test_fastq(spark, tmp_path, pack):
    records = [(f"r{i} x", dna(i, i), "".join(chr(33 + (i + j) % 60) for j in range(i))) for i in (5, 40, 0, 140)] + [("at", "ACGT", "@+@+")]
    path = fastq(tmp_path / ("x.fastq.gz" if pack else "x.fq"), records, pack)
    rows = read_sequences(spark, path).orderBy("read_ord").collect()
    assert [(r.read_ord, r.header, r.seq, r.qual) for r in rows] == [(n, i, s, q) for n, (i, s, q) in enumerate(records)]
    means = read_fastq(spark, path).select("id", C.mean_quality(F.col("qual")).alias("m"), C.compression_ratio(F.col("seq")).alias("z")).collect()
    for r in means:
        q = next(q for i, _, q in records if i.split(" ")[0] == r.id)
        assert abs(r.m - (sum(ord(c) - 33 for c in q) / len(q) if q else 0)) < 1e-9


def test_what_is_no_fastq(spark, tmp_path):
    (tmp_path / "bad.fq").write_text("@a\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="not a FASTQ record"):
        read_fastq(spark, str(tmp_path / "bad.fq")).collect()
    with pytest.raises(ValueError):
        read_sequences(spark, "x.txt")


def test_pairs(spark, tmp_path):
    def mates(name, ids):
        return read_fastq(spark, fastq(tmp_path / name, [(i, "ACGT", "IIII") for i in ids]))

    good = pair(mates("a1.fq", ["x/1", "y/1"]), mates("a2.fq", ["x/2", "y/2"])).collect()
    assert sorted(r.id for r in good) == ["x/1", "y/1"]
    for one, two in ((["x/1"], ["z/2"]), (["x/1", "y/1"], ["x/2"])):
        with pytest.raises(Exception, match="mates do not match"):
            pair(mates("b1.fq", one), mates("b2.fq", two)).collect()


def test_scalar_functions(spark):
    row = spark.createDataFrame([("a,,b,", "dir.x/reads.fastq.gz", "id rest of it", "acgUn-R")], "s string, p string, h string, q string").select(
        C.split(F.col("s"), ","), C.extension(F.col("p")), C.read_id(F.col("h")), C.normalise(F.col("q")), C.starts_with(F.col("s"), "a,"), C.ends_with(F.col("s"), "x"),
        C.category_index(["a", "b"], F.lit("b")), C.category_index(["a", "b"], F.lit("c")), C.category_name(["a", "b"], F.lit(1)), C.category_name(["a", "b"], F.lit(2)),
    ).collect()[0]
    assert tuple(row) == (["a", "", "b", ""], ".fastq", "id", "ACGTNNN", True, False, 1, None, "b", "")


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    host, other = dna(100, 4000), dna(200, 4000)
    fasta(d / "host.fa", [("chr1", host[:2500]), ("chr2", host[2500:])])
    fasta(d / "other.fa", [("g", other)])
    (d / "m.tsv").write_text(f"{d}/host.fa\thuman\n{d}/other.fa\tmicrobe\n")
    r = random.Random(3)
    reads = []
    for i in range(30):
        g = (host, other)[i % 2]
        a = r.randrange(3000)
        reads.append((f"r{i}/1", g[a : a + 300], "I" * 300))
    fastq(d / "reads_1.fastq", reads)
    fastq(d / "reads_2.fastq", [(i[:-1] + "2", s[::-1].translate(str.maketrans("ACGT", "TGCA")), q) for i, s, q in reads])
    return d


def test_commands(spark, files, capsys):
    d = str(files)
    assert cli.main(["index", f"{d}/m.tsv", "-p", f"{d}/db.idx", "--log", f"{d}/log"]) == 0
    args = ["--db", f"{d}/db", "--log", f"{d}/log", "-v"]
    cli.main(["dehost", f"{d}/reads_1.fastq", *args, "-e", "all", "-p", f"{d}/out"])
    lines = capsys.readouterr().out.splitlines()
    assert len(lines) == 30
    for line in lines:
        status, read, call, length, *_ = line.split("\t")
        assert status == "C" and length == "300"
        assert call == ("human", "microbe")[int(read[1:-2]) % 2]
    kept = read_fastq(spark, f"{d}/out_human.fastq.gz")
    assert sorted(r.id for r in kept.collect()) == sorted(f"r{i}/1" for i in range(0, 30, 2))
    cli.main(["classify", f"{d}/reads_1.fastq", f"{d}/reads_2.fastq", *args, "-o", f"{d}/lines"])
    assert spark.read.text(f"{d}/lines").where("value like 'C%'").count() == 30
    cli.main(["dehost", f"{d}/reads_1.fastq", f"{d}/reads_2.fastq", *args, "-e", "human", "-p", f"{d}/pair", "-o", f"{d}/lines2"])
    one, two = (read_fastq(spark, f"{d}/pair_human_{i}.fastq.gz").orderBy("read_ord").collect() for i in (1, 2))
    assert [r.id[:-1] for r in one] == [r.id[:-1] for r in two] and len(one) == 15
    assert "human: 15" in open(f"{d}/log").read()
    for bad in (["-e", "nobody"], ["-d", "normal"]):
        with pytest.raises((ValueError, SystemExit)):
            cli.main(["dehost", f"{d}/reads_1.fastq", *args, *bad])


def test_stream_as_batch(spark, files, tmp_path):
    d = str(files)
    model = pipeline.index(spark, read_manifest(spark, f"{d}/m.tsv"), str(tmp_path / "s.idx"), IndexSettings())
    reads = read_fastq(spark, f"{d}/reads_1.fastq").select("read_ord", "id", "seq", "qual")
    reads.repartition(3).write.parquet(str(tmp_path / "reads"))
    settings = DehostSettings()
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "reads"))
    out = call_stream(stream, model, settings).select("read_ord", "call", "confidence")
    query = out.writeStream.format("memory").queryName("calls").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    batch = pipeline.dehost(reads, model, settings).select("read_ord", "call", "confidence")
    assert sorted(map(tuple, spark.table("calls").collect())) == sorted(map(tuple, batch.collect()))
    paired = pair(reads, reads)
    assert pipeline.dehost(paired, model, settings).where("length = 600").count() == 30
    trained = pipeline.dehost(reads, model, DehostSettings(training="first_n", num_reads_to_fit=5)).where("call is not null")
    assert trained.count() == 30


def test_without_qualities_nothing_is_called(spark, files, tmp_path):
    d = str(files)
    model = pipeline.index(spark, read_manifest(spark, f"{d}/m.tsv"), str(tmp_path / "q.idx"))
    called = pipeline.classify(read_fasta(spark, f"{d}/host.fa"), model, ClassifySettings())
    assert called.where("call is null").count() == 2
    rows = sinks.assignment_text(sinks.assignments(called, model.categories())).collect()
    assert all(r.value.startswith("U\tchr") for r in rows)
