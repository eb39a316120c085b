"""Readers, writers and runs from files."""

import gzip
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import vectors as V
from weft.functions.dynamic import align_and_merge
from weft.lineage import checkpointed
from weft.operators import alignment as A, multiple, stats, strings
from weft.options import AlignOptions
from weft.sources import sinks, text

ONE = ">one\nG\t20.0\t12.0\t13.0\t14.0\nH\t20.0\t12.0\t13.0\t14.0\n# comment\n\nK\t20.0\t8.0\t13.0\t14.0\n"
TWO = ">two some words\t\n@ 1 0 0.1 0.9\nA 1 2 3 4\n@ 0.5 0.5 0 0.95\nC -5 6.5 7 8\n@ 1 0 0 0.95\n>three\nD 0 0 0   1\n"


@pytest.fixture
def files(tmp_path):
    (tmp_path / "one.gmat").write_text(ONE)
    with gzip.open(tmp_path / "two.gmat.gz", "wt") as f:
        f.write(TWO)
    (tmp_path / "list.dat").write_text(f"{tmp_path}/one.gmat  \n\n# no\n{tmp_path}/two.gmat.gz\n")
    return tmp_path


def test_gmat_records(spark, files):
    rows = text.read_gmat(spark, [str(files / "two.gmat.gz"), str(files / "one.gmat")]).orderBy("seq_ord", "pos").collect()
    assert [(r.seq_ord, r.name, r.pos, r.residue) for r in rows[:3]] == [(0, "two some words\t", 0, "A"), (0, "two some words\t", 1, "C"), (0, "two some words\t", 2, None)]
    assert rows[1].vec == [-5, 6.5, 7, 8] and (rows[0].match_to_del, rows[1].match_ratio) == (pytest.approx(0.1), 0.5)
    assert [r.name for r in rows[3:5]] == ["three", "three"] and [r.residue for r in rows[5:]] == ["G", "H", "K", None]
    assert rows[-1].vec == [0] * 4 and rows[-1].del_to_del == pytest.approx(0.95)


@pytest.mark.parametrize("broken", [">x\nA 1 2\nC 1\n", ">x\nAB 1 2\n", ">x\n@ 1 0 0\nA 1\n@ 1 0 0 1\n", ">x\n@ 1 0 0 1\nA 1\n"])
def test_malformed_gmat(spark, tmp_path, broken):
    (tmp_path / "x.gmat").write_text(broken)
    with pytest.raises(Exception, match="malformed record x"):
        text.read_gmat(spark, [str(tmp_path / "x.gmat")]).collect()


def test_no_row_of_a_position_carries_all_states_of_its_record(spark, files):
    plan = text.read_gmat(spark, [str(files / "one.gmat"), str(files / "two.gmat.gz")])._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate posexplode(CASE")]
    assert "rows#" not in above and "states#" not in above


def test_fasta_is_read_without_python_workers(spark, tmp_path):
    (tmp_path / "a.fas").write_text(">a x\nMK\n>b\nAC\n")
    rows = text.read_fasta(spark, [str(tmp_path / "a.fas")])
    names = [rdd for rdd in rows._jdf.queryExecution().toRdd().toDebugString().splitlines() if "Python" in rdd]
    assert not names and "ExistingRDD" not in text._in_order(text._text(spark, [str(tmp_path / "a.fas")]).select(F.input_file_name().alias("path")), [str(tmp_path / "a.fas")])._jdf.queryExecution().toString()
    assert [r.seq for r in rows.orderBy("ord").collect()] == ["MK", "AC"]


def test_record_without_header(spark, tmp_path):
    (tmp_path / "x.gmat").write_text("A 1 2\n>y\nC 3 4\n")
    names = text.read_gmat(spark, [str(tmp_path / "x.gmat")]).where("residue IS NOT NULL").orderBy("seq_ord").collect()
    assert [(r.name, r.residue) for r in names] == [("", "A"), ("y", "C")]


def test_records_are_numbered_over_files_without_moving_their_texts(spark, tmp_path):
    paths = []
    for n in range(5):
        (tmp_path / f"{n}.gmat").write_text(("A 1 2\n" if n % 2 else "# only a comment\n\n") + "".join(f">r{n}{k}\nC {k} {n}\n" for k in range(n)))
        paths.append(str(tmp_path / f"{n}.gmat"))
    rows = text.read_gmat(spark, paths[::-1])
    want = [name for n in (4, 3, 2, 1, 0) for name in ([""] if n % 2 else []) + [f"r{n}{k}" for k in range(n)]]
    assert [(r.seq_ord, r.name) for r in rows.where("residue IS NOT NULL").orderBy("seq_ord").collect()] == list(enumerate(want))
    assert "SinglePartition" not in rows._jdf.queryExecution().toString()
    (tmp_path / "a.fas").write_text("no header\n>a x\nMK\n>b\n")
    (tmp_path / "b.fas").write_text(">c\nAC\n")
    fasta = text.read_fasta(spark, [str(tmp_path / "b.fas"), str(tmp_path / "a.fas")])
    assert [tuple(r) for r in fasta.orderBy("ord").collect()] == [(0, "c", "", "AC"), (1, "a", "x", "MK"), (2, "b", "", "")]


@pytest.fixture
def tiny_blocks(spark):
    """Files are cut into blocks of a few bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def cut(size):
        for n, x in zip(names, (size, 0), strict=True):
            spark.conf.set(n, str(x))

    yield cut
    for n, x in zip(names, before, strict=True):
        spark.conf.set(n, x)


def brute_fasta(content):
    found = []
    for line in re.split(r"\r\n|\r|\n", content):
        if ">" in line:
            found.append([line.split(">", 1)[1], ""])
        elif found:
            found[-1][1] += re.sub(r"\s", "", line)
    return [(h.strip().split(None, 1)[0] if h.strip() else "", seq) for h, seq in found]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_records_of_one_file_are_read_in_blocks(spark, tmp_path, tiny_blocks, size):
    rng = random.Random(size)
    texts = []
    for n in range(4):
        records = "".join(f">s{n}_{k} d>e{eol}" + "".join("MK" * rng.randint(0, 9) + eol for _ in range(rng.randint(0, 3))) for k in range(6) for eol in [rng.choice(["\n", "\r\n", "\n\n"])])
        texts.append(["", "in front\n", "\n\n", ""][n] + records + ["", "\n>\n", "\nx>odd header\nAC\n", ">last"][n])
    texts += ["", ">a\rAC\r>b\rMK\r", "no record"]
    paths = []
    for n, content in enumerate(texts):
        (tmp_path / f"f{n}.fas").write_bytes(content.encode())
        paths.append(str(tmp_path / f"f{n}.fas"))
    paths = paths[3:] + paths[:3]
    tiny_blocks(size)
    pieces = text.record_pieces(spark, paths)
    assert size > 7 or pieces.select("file_ord", "block").distinct().count() > 20
    rows = text.read_fasta(spark, paths).orderBy("ord").collect()
    want = [r for content in texts[3:] + texts[:3] for r in brute_fasta(content)]
    assert [(r.name, r.seq) for r in rows] == want and [r.ord for r in rows] == list(range(len(want)))


@pytest.mark.parametrize("size", [11, 90])
def test_profiles_of_one_file_are_read_in_blocks(spark, tmp_path, tiny_blocks, size):
    body = "# head\n\n" + "".join(f">r{k} x\n@ 1 0 0 1\nA {k} 2\n# c\n\n@ 1 0 0 0.5\n" for k in range(30))
    (tmp_path / "one.gmat").write_text(body)
    (tmp_path / "two.gmat").write_text("A 1 2\n" + body)
    tiny_blocks(size)
    rows = text.read_gmat(spark, [str(tmp_path / "two.gmat"), str(tmp_path / "one.gmat")]).where("residue IS NOT NULL").orderBy("seq_ord").collect()
    want = [""] + [f"r{k} x" for k in range(30)] * 2
    assert [(r.seq_ord, r.name) for r in rows] == list(enumerate(want))
    assert [r.vec[0] for r in rows] == [1.0, *map(float, range(30)), *map(float, range(30))]
    limited = text.read_gmat(spark, [str(tmp_path / "one.gmat")], max_records=7)
    assert limited.select("name").distinct().count() == 7


def test_tree_tasks_cover_chains_and_balanced_trees():
    n = 100
    chain = [(n + i, 0 if i == 0 else n + i - 1, i + 1, 0.5, 0.5) for i in range(n - 1)]
    balanced, live, number = [], list(range(64)), 64
    while len(live) > 1:
        live = [balanced.append((number + i, live[2 * i], live[2 * i + 1], 0.5, 0.5)) or number + i for i in range(len(live) // 2)]
        number += len(live)
    for steps, rounds in ((chain, 7), (balanced, 2)):
        made, tasks = set(range(n)), multiple.rounds_of(steps)
        assert len(tasks) == rounds and sorted(s for t in tasks for x in t.values() for s in x) == sorted(steps)
        for turn in tasks:
            for task, mine in turn.items():
                held = {s[0] for s in mine}
                going = [c for s in mine for c in s[1:3] if c not in held]
                assert len(going) <= multiple.TASK_INPUTS and set(going) <= made and mine[-1][0] == task
            made |= set(turn)


def test_column_statistics(spark, tmp_path):
    first = "GHIKLGHIKL"
    values = [[20, 12, 13, 14]] * 10
    values[3], values[5], values[7], values[9] = [20, 8, 13, 14], [20, -6, 4, 2], [-5, 12, 13, 14], [0, 12, 13, 14]
    (tmp_path / "a.gmat").write_text(">a\n" + "".join(f"{c}\t" + "\t".join(map(str, v)) + "\n" for c, v in zip(first, values, strict=True)))
    rows = text.read_gmat(spark, [str(tmp_path / "a.gmat")]).where("residue IS NOT NULL")
    got = {r.dim: r for r in stats.column_stats(rows).collect()}
    for d in range(4):
        x = np.array([v[d] for v in values], float)
        assert (got[d].max, got[d].min, got[d].sum, got[d]["count"]) == (x.max(), x.min(), x.sum(), 10)
        assert got[d].mean == pytest.approx(x.mean()) and got[d].var == pytest.approx(x.var())
    lines = stats.column_stats(rows).select("dim", text.stats_line().alias("line"))
    sinks.save_lines(lines, str(tmp_path / "stats"), ["dim"])
    again = text.read_stats(spark, next(str(p) for p in (tmp_path / "stats").glob("part-*"))).orderBy("dim").collect()
    assert [r.mean for r in again] == pytest.approx([got[d].mean for d in range(4)])
    with pytest.raises(Exception, match="no max"):
        text.parse_stats(spark.createDataFrame([(0, "sum:\t1\tvar:\t2\tcount:\t3")], "dim int, line string")).collect()


def test_normalise_needs_variance(spark):
    rows = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "vec array<float>")
    with pytest.raises(Exception, match="no variance"):
        stats.normalise(rows, stats.column_stats(rows)).collect()


def test_kernels_reject_other_lengths(spark):
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<float>, b array<float>").select(V.dot(F.col("a"), F.col("b"))).collect()


def test_kernel_fixture(spark):
    a, b = [1.0, 2.4, 3.2, 2.4, 3.2, 2.4, 3.2, 2.4, 3.2], [5.3, 1.2, 1.1, 2.4, 3.2, 2.4, 3.2, 2.4, 3.2]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    ca, cb = F.col("a"), F.col("b")
    r = df.select(V.dot(ca, cb).alias("dot"), V.euclid(ca, cb).alias("d"), V.element_add(ca, 32.0).alias("add"), V.vector_max(ca, cb).alias("m"), V.vector_sqrt(ca).alias("r")).first()
    assert r.dot == pytest.approx(np.dot(a, b)) and r.d == pytest.approx(np.linalg.norm(np.subtract(a, b)))
    assert r["add"] == pytest.approx(np.add(a, 32)) and r.m == np.maximum(a, b).tolist() and r.r == pytest.approx(np.sqrt(a))
    V.register_sql(spark)
    assert spark.sql("SELECT vec_dot(array(1D,2D), array(3D,4D)) d, vec_euclid(array(0D,0D), array(3D,4D)) e").first().asDict() == {"d": 11.0, "e": 5.0}


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fas").write_text(">s1 first one\nmkv\nLLa\n\n  >s2\nAC D\n")
    rows = text.read_fasta(spark, [str(tmp_path / "a.fas")]).orderBy("ord").collect()
    assert [tuple(r) for r in rows] == [(0, "s1", "first one", "mkvLLa"), (1, "s2", "", "ACD")]
    profile = text.fasta_profiles(text.read_fasta(spark, [str(tmp_path / "a.fas")])).where("seq_ord = 0").orderBy("pos").collect()
    assert "".join(r.residue for r in profile[:-1]) == "MKVLLA" and profile[-1].residue is None and len(profile[0].vec) == 20


def test_hhm(spark):
    body = "HHsearch\nNAME  q1 x\nNULL 1 2\nHMM A C\n  M->M\n 0 *\nM 1  " + " ".join(["0", "1000", "*"] + ["2000"] * 17) + " 1\n 0 0\n\nK 2  " + " ".join(["500"] * 20) + " 2\n 0 0\n\n//\n"
    rows = text.parse_hhm(spark.createDataFrame([(0, body)], "file_ord int, text string")).orderBy("pos").collect()
    assert [(r.name, r.pos, r.residue) for r in rows] == [("q1", 0, "M"), ("q1", 1, "K")]
    assert rows[0].vec[:4] == [1.0, 0.5, 0.0, 0.25] and rows[1].vec == [0.70711] * 20


def test_all_routes_of_input_give_the_same(spark, files):
    direct = text.read_gmat(spark, [str(files / "one.gmat"), str(files / "two.gmat.gz")])
    listed = text.read_gmat(spark, text.read_list(spark, [str(files / "list.dat")]))
    options = AlignOptions(score_type="dot_product", tree_type="UPGMA")
    texts = []
    for n, rows in enumerate((direct, listed)):
        packed = A.pack_profiles(rows)
        aligned = multiple.aligned_rows(packed, multiple.multiple_alignment(packed, options))
        path = str(files / f"out{n}") + (".gz" if n else "")
        sinks.save_lines(sinks.fasta_lines(aligned), path, ["seq_ord", "part"])
        texts.append([r.value for r in spark.read.text(path).collect()])
    assert texts[0] == texts[1] and [t.replace("-", "") for t in texts[0][1::2]] == ["GHK", "AC", "D"]


def test_command_line_routes(spark, files):
    from weft import cli

    read = lambda name: [r.value for r in spark.read.text(str(files / name)).collect()]
    one, two, listed = (str(files / n) for n in ("one.gmat", "two.gmat.gz", "list.dat"))
    common = ["--tree_type", "UPGMA", "--score_type", "dot_product"]
    cli.run(spark, ["--in", f"{one},{two}", "--out", str(files / "a"), "--out_stats", str(files / "s"), "--out_matrix", str(files / "m"), *common])
    cli.run(spark, ["--in_list", listed, "--in_stats", next(str(p) for p in (files / "s").glob("part-*")), "--out", str(files / "b.gz"), *common])
    assert read("a") == read("b.gz") and read("a")[0::2] == [">one", ">two some words\t", ">three"]
    assert len(read("s")) == 4 and read("m")[0].startswith(">") and read("m")[-1].startswith("@")
    found = cli.run(spark, ["--in_list", listed, "--a3m_pairwise", "--alignment_type", "local", "--out", str(files / "c")])
    assert read("c")[:2] == [">one", "GHK"] and found["a3m"].count() == 2
    (files / "x.fas").write_text(">q\nMKVLA\n>t\nMKLA\n>u\nMKVVLA\n")
    cli.run(spark, ["--in_fasta", str(files / "x.fas"), "--normalize", "false", "--score_type", "dot_product", "--out", str(files / "f")])
    assert [t.replace("-", "") for t in read("f")[1::2]] == ["MKVLA", "MKLA", "MKVVLA"]


def test_gmat_writer(spark, files):
    lines = [r.line for r in sinks.gmat_lines(text.read_gmat(spark, [str(files / "two.gmat.gz")])).orderBy("seq_ord", "pos", "part").collect()]
    assert lines[:3] == [">two some words\t", "@\t1.00000\t0.00000\t0.10000\t0.90000", "A\t1.00000\t2.00000\t3.00000\t4.00000"]


def test_duplicate_names_are_refused(spark, files):
    rows = text.read_gmat(spark, [str(files / "one.gmat")])
    twice = A.pack_profiles(rows).unionByName(A.pack_profiles(rows).withColumn("seq_ord", F.col("seq_ord") + 1))
    with pytest.raises(ValueError, match="duplicated name one"):
        multiple.multiple_alignment(twice, AlignOptions())


def test_fragments_and_names(spark):
    fasta = spark.createDataFrame([("a", "ABCDEFGHIK" * 3), ("b", "ac-jd"), ("c", "J")], "name string, seq string")
    rows = strings.crop_fragments(fasta, 12, 8).orderBy("name", "start").collect()
    assert [(r.name, r.start, len(r.fragment)) for r in rows] == [("a", 0, 12), ("a", 8, 12), ("a", 16, 12), ("a", 18, 12), ("b", 0, 3)]
    assert rows[-1].fragment == "ACD"
    assert spark.createDataFrame([("x/y z",)], "n string").select(strings.safe_file_name(F.col("n"))).first()[0] == "x_y.gz"
    with pytest.raises(ValueError, match="missing"):
        strings.sum_of_pairs(spark.createDataFrame([("AC",), ("AD",)], "aligned string"), spark.createDataFrame([("AC",)], "aligned string"))


def test_split_writer(spark, tmp_path):
    strings.write_split(spark.createDataFrame([("a x", "1"), ("b", "2")], "name string, line string"), str(tmp_path / "s"))
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["record=a.gz", "record=b.gz"]


def test_streamed_search_equals_batch(spark, files, tmp_path):
    from weft.streaming.search import run_search, stream_search

    packed = A.pack_profiles(text.read_gmat(spark, [str(files / "one.gmat"), str(files / "two.gmat.gz")]))
    query = A.unpack("q", packed.where("seq_ord = 0").first().columns)
    packed.repartition(3).write.parquet(str(tmp_path / "in"))
    options = AlignOptions(alignment_type="local", score_type="dot_product")
    done = run_search(stream_search(spark, str(tmp_path / "in"), query, options), str(tmp_path / "res"), str(tmp_path / "cp"))
    done.awaitTermination(120)
    streamed = spark.read.schema(A.A3M).parquet(str(tmp_path / "res")).orderBy("seq_ord").collect()
    assert streamed == A.a3m_search(query, packed, options).orderBy("seq_ord").collect() and len(streamed) == 3


def test_hierarchy_of_noisy_copies(spark):
    rng = np.random.default_rng(8)
    base = [rng.standard_normal((n, 4)) * 3 for n in (9, 12, 7)]
    rows = []
    for n in range(36):
        b = base[n % 3] + rng.standard_normal(base[n % 3].shape) * 0.05
        rows += [(n, f"s{n}", i, "ACDEFGHIKLMN"[i], v.tolist(), 1.0, 0.0, 0.0, 0.95) for i, v in enumerate(b)]
    packed = A.pack_profiles(spark.createDataFrame(rows, text.PROFILE))
    found = multiple.multiple_alignment(packed, AlignOptions(max_cluster_size=13))
    aligned = {r.name: r.aligned for r in multiple.aligned_rows(packed, found).collect()}
    assert sorted(aligned, key=lambda s: int(s[1:])) == [f"s{n}" for n in range(36)]
    assert all(aligned[f"s{n}"].replace("-", "") == "ACDEFGHIKLMN"[: len(base[n % 3])] for n in range(36))
    assert {len(x) for x in aligned.values()} == {found.whole.first().length}
    assert len({aligned[f"s{n}"] for n in range(1, 36, 3)}) == 1  # copies of one record agree
    assert found.places.where("first").count() == 1


def random_profiles(spark, count, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for n in range(count):
        length = int(rng.integers(3, 9))
        rows += [(2 * n, f"s{n}", i, "ACDEFGHIK"[i], rng.standard_normal(3).tolist(), 1.0, 0.0, 0.1, 0.9) for i in range(length)]
    packed = A.pack_profiles(spark.createDataFrame(rows, text.PROFILE))
    return packed, [A.unpack(r.name, r.columns) for r in packed.orderBy("seq_ord").collect()]


def by_steps(profiles, steps, options):
    """All members' aligned strings, from whole profiles merged one by one."""
    held = {2 * n: (p, 0.0) for n, p in enumerate(profiles)}
    for node, a, b, weights in steps:
        held[node] = align_and_merge(held.pop(a)[0], held.pop(b)[0], options, weights)
    return {name: (p.aligned(k), round(score, 6)) for p, score in held.values() for k, name in enumerate(p.names)}, {p.names[0] for p, _ in held.values()}


def test_pairs_of_profiles_are_made_without_a_task_for_each_pair_of_partitions(spark):
    packed, _ = random_profiles(spark, 5, 4)
    pairs = A.all_pairs(checkpointed(A.profile_blobs(packed)))
    assert "CartesianProduct" not in pairs._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, pairs.collect())) == [(2 * a, 2 * b) for a in range(5) for b in range(a + 1, 5)]


@pytest.mark.parametrize("kind", ["NJ", "UPGMA", "fold", "edges"])
def test_merges_in_tasks_equal_merges_of_whole_profiles(spark, monkeypatch, kind):
    monkeypatch.setattr(multiple, "TASK_INPUTS", 3)
    packed, profiles = random_profiles(spark, 11, 3)
    options = AlignOptions(tree_type="UPGMA" if kind == "UPGMA" else "NJ", tree_guided=kind != "fold", alignment_type="local" if kind == "UPGMA" else "global")
    order = [2 * n for n in range(11)]
    if kind == "edges":
        edges = [(0, 1), (1, 0), (2, 5), (5, 1), (9, 8), (10, 9)]
        found = multiple.edge_alignment(packed, edges, options, merge_all=False)
        steps = multiple.edge_steps(order, edges, 100, False)
    else:
        found = multiple.multiple_alignment(packed, options)
        points = np.array([p.mean_vector() for p in profiles])
        steps = multiple.fold_steps(order, 100) if kind == "fold" else multiple.tree_steps(points, order, 100, options)
        assert len(multiple.rounds_of(steps)) >= 2
    want, leading = by_steps(profiles, steps, options)
    rows = multiple.aligned_rows(packed, found).collect()
    assert {r.name: (r.aligned, round(r.last_merge_score, 6)) for r in rows} == want
    first = {r.node for r in found.places.where("first").collect()}
    assert {f"s{n // 2}" for n in first} == leading
    long = multiple.merged_profile(packed, found)
    shown = {r.name: "".join(x for x in r.t if x is not None) for r in long.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("pos", "residue"))).alias("t")).select("name", F.col("t.residue").alias("t")).collect()}
    assert shown == {name: want[name][0] for name in leading}


def test_iterations_and_small_collections(spark):
    packed, profiles = random_profiles(spark, 4, 5)
    found = multiple.multiple_alignment(packed, AlignOptions(num_iter=3))
    rows = multiple.aligned_rows(packed, found).collect()
    assert sorted(r.name for r in rows) == ["s0", "s1", "s2", "s3"]
    residues = {p.names[0]: p.residues[0] for p in profiles}
    assert all(r.aligned.replace("-", "") == residues[r.name] and len(r.aligned) == found.whole.first().length for r in rows)
    for n in (1, 2, 3):
        few = packed.where(F.col("seq_ord") < 2 * n)
        for options in (AlignOptions(), AlignOptions(tree_guided=False), AlignOptions(max_cluster_size=13)):
            assert multiple.aligned_rows(few, multiple.multiple_alignment(few, options)).count() == n
