"""The command line from raw corpus to comparison table."""

import pytest

from termloom.__main__ import main, parser


def test_commands_end_to_end(spark, tmp_path, capsys):
    names = ["diabetes", "influenza", "asthma", "malaria", "rabies", "psoriasis"]
    lines = [
        "\t".join([str(i), "0", "5", f"{form}{name}", "T047", f"UMLS:C{names.index(name)}"])
        for i in range(10)
        for name in names
        for form in ("", "acute ", "old ")
    ]
    (tmp_path / "corpus.txt").write_text("1|t|title\n" + "\n".join(lines))
    (tmp_path / "map.tsv").write_text("".join(f"C{i}\tE{i}\n" for i in range(len(names))))
    data, catalog, results = (str(tmp_path / d) for d in ("data", "catalog", "results"))
    splits = {s: f"{data}/split={s}" for s in ("train", "dev", "test")}

    main(["prepare", "--corpus", f"{tmp_path}/corpus.txt", "--mapping", f"{tmp_path}/map.tsv", "--output", data])
    assert "100.0" in capsys.readouterr().out
    main(["build-catalog", "--train", splits["train"], "--output", catalog])
    assert spark.read.json(f"{catalog}_metadata").first().num_entities == 6
    main(["link", "--catalog", catalog, "--mention", "acute malaria", "--top_k", "1"])
    assert "E3" in capsys.readouterr().out
    main(
        ["evaluate", "--catalog", catalog, "--output", results, "--max_samples", "10"]
        + [f"--{s}={p}" for s, p in splits.items()]
    )
    table = capsys.readouterr().out
    assert "Hits@10" in table and "classifier" in table and "vectors" in table
    out = str(tmp_path / "requests")
    main(["requests", "--train", splits["train"], "--test", splits["test"], "--output", out])
    assert spark.read.json(out).count() == 2 * 18


def test_unknown_command():
    with pytest.raises(SystemExit):
        parser().parse_args(["nothing"])
