"""Preprocessing from files against plain loops."""

import gzip

import numpy as np
import pytest

from tessera.plans import preprocess

BASES = "ACGT"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Two slices of 12 spots, 30 sites on three chromosomes, 8 genes."""
    rng = np.random.default_rng(5)
    top = tmp_path_factory.mktemp("files")
    (top / "pileup").mkdir()
    (top / "phased").mkdir()
    sites = [(1 + i // 10, 100 * (1 + i % 10), "A", BASES[1 + i % 3]) for i in range(30)]
    kind = {i: ["0|1", "1|0", "1|1", None][int(rng.integers(0, 4))] for i in range(30)}
    for c in (1, 2, 3):
        lines = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tS"]
        lines += [f"chr{c}\t{pos}\t.\t{r}\t{a}\t.\t.\t.\tGT\t{kind[i]}" for i, (k, pos, r, a) in enumerate(sites) if k == c and kind[i]]
        (top / f"phased/x.chr{c}.phased.vcf.gz").write_bytes(gzip.compress(("\n".join(lines) + "\n").encode()))
    (top / "pileup/cellSNP.base.vcf").write_text("##x\n#CHROM\n" + "".join(f"{c}\t{pos}\t.\t{r}\t{a}\t.\t.\tAD=1\n" for c, pos, r, a in sites))
    labels = [f"BC{k}_{s}" for s in ("one", "two") for k in range(12)]
    order = [labels[i] for i in rng.permutation(len(labels))]
    (top / "pileup/cellSNP.samples.tsv").write_text("\n".join(order) + "\n")
    dp = rng.poisson(6, (30, 24))
    dp[:, order.index("BC3_one")] = 0  # too few allele reads
    ad = rng.binomial(dp, 0.4)
    for tag, m in (("AD", ad), ("DP", dp)):
        at = np.argwhere(m)
        (top / f"pileup/cellSNP.tag.{tag}.mtx").write_text(f"%%MatrixMarket\n%\n30\t24\t{len(at)}\n" + "".join(f"{i + 1}\t{j + 1}\t{m[i, j]}\n" for i, j in at))
    (top / "barcodes.txt").write_text("\n".join(x for x in labels if x != "BC11_two") + "\n")
    (top / "genes.txt").write_text("g1\n")
    (top / "ranges.tsv").write_text("chr1\t100\t301\nchr3\t500\t501\n")
    sheet = "sample_id\tsnp_dir\tspaceranger_dir\n"
    umi = {}
    for s in ("one", "two"):
        own = top / s
        own.mkdir()
        sheet += f"U-{s}\tx\t{own}\n"
        (own / "tissue_positions.csv").write_text("barcode,in_tissue,x,y,px,py\n" + "".join(f"BC{k},{int(k != 5)},{k},{k % 3},0,0\n" for k in range(12)))
        rows = [(f"U-{s}", f"BC{k}", f"g{g}", float(rng.poisson(20)) if g != 7 else float(k == 0 and s == "one")) for k in range(12) for g in range(8)]
        umi |= {(f"BC{k}_U-{s}", g): v for (_, b, g, v) in rows for k in [b[2:]] if v}
        import pandas as pd

        pd.DataFrame(rows, columns=["sample", "barcode", "gene", "umi"]).to_parquet(own / "counts.parquet")
    (top / "sheet.tsv").write_text(sheet)
    return top, sites, kind, order, ad, dp, umi


def plain_alleles(folder):
    top, sites, kind, order, ad, dp, _ = folder
    listed = set((top / "barcodes.txt").read_text().split())
    out = set()
    for i, (c, pos, r, a) in enumerate(sites):
        for j, label in enumerate(order):
            if kind[i] in ("0|1", "1|0") and label in listed and dp[i, j]:
                b = int(ad[i, j] if kind[i] == "0|1" else dp[i, j] - ad[i, j])
                out.add((f"{c}_{pos}_{r}_{a}", label, int(dp[i, j]) - b, b))
    return out


def test_allele_matrices(spark, folder):
    top = folder[0]
    got = preprocess.allele_matrices(spark, str(top / "pileup"), str(top / "phased"), str(top / "barcodes.txt"), (1, 2, 3))
    rows = [tuple(r) for r in got.select("snp_id", "label", "a", "b").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_alleles(folder)
    with pytest.raises(FileNotFoundError, match="4"):
        preprocess.allele_matrices(spark, str(top / "pileup"), str(top / "phased"), str(top / "barcodes.txt"), range(1, 5))


def test_inputs_of_two_slices(spark, folder):
    top, umi = folder[0], folder[-1]
    alleles = spark.createDataFrame(sorted(plain_alleles(folder)), "snp_id string, label string, a long, b long")
    found = preprocess.load_inputs(spark, str(top / "sheet.tsv"), str(top / "barcodes.txt"), alleles, genes=str(top / "genes.txt"), ranges=str(top / "ranges.tsv"), share=0.2, outliers=False)
    held = {f"BC{k}_U-{s}" for s in ("one", "two") for k in range(12) if k != 5 and (k, s) not in ((11, "two"), (3, "one"))}
    assert {r.label for r in found.spots.collect()} == held and found.spots.count() == len(held)
    want = {(x, g, int(v)) for (x, g), v in umi.items() if x in held and g not in ("g1", "g7")}  # g1 is listed, g7 shows in one spot
    assert {tuple(r) for r in found.counts.collect()} == want
    kept = {(s, x.replace("_", "_U-"), a, b) for s, x, a, b in plain_alleles(folder) if not (s.startswith("1_") and int(s.split("_")[1]) < 301) and not s.startswith("3_500_")}
    assert {tuple(r) for r in found.alleles.collect()} == {r for r in kept if r[1] in held}


def test_lines_are_numbered_over_blocks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"a{i}\n" for i in range(5000)))
    (tmp_path / "b.txt").write_text("".join(f"b{i}\n" for i in range(70)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = preprocess.numbered(spark.read.text(str(tmp_path)))
        assert [r.value for r in rows.orderBy("row").collect()] == [f"a{i}" for i in range(5000)] + [f"b{i}" for i in range(70)]
        assert rows.agg({"row": "max"}).first()[0] == 5069
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
