"""Command line: thin over the library. ``python -m spanframe.cli --help``."""

from __future__ import annotations

import argparse
import json
import os
import shutil
import sys
import tempfile
from collections.abc import Iterable, Sequence
from contextlib import ExitStack

from spanframe import __version__
from spanframe.functions.config import FormatError, resolve
from spanframe.functions.regions import RegionError, parse_region, read_region_file, resolve_sequence
from spanframe.sources.bgzf import BlockError, Gzi, checked, inflate, manifest, members, read_range


def guard_output(output: str | None, inputs: Sequence[str], force: bool) -> None:
    """Refuse to write over an input, over anything but a file, or over a file unless forced."""
    if output is None:
        return
    for name in inputs:
        if os.path.exists(output) and os.path.exists(name) and os.path.samefile(output, name):
            raise ValueError(f"{output} is an input")
    if os.path.exists(output) and (not os.path.isfile(output) or not force):
        raise FileExistsError(output)


def _write(parts: Iterable[bytes], output: str | None) -> int:
    """Write parts as they come, to a file that takes its name when it is whole; the number of bytes."""
    n = 0
    if output is None:
        for part in parts:
            n += sys.stdout.buffer.write(part)
        sys.stdout.buffer.flush()
        return n
    staged = output + ".staged"
    try:
        with open(staged, "wb") as f:
            for part in parts:
                n += f.write(part)
        os.replace(staged, output)
    finally:
        if os.path.exists(staged):
            os.remove(staged)
    return n


def _write_all(files: Sequence[tuple[str, bytes]]) -> None:
    """Several files: none takes its name before all are written."""
    try:
        for name, data in files:
            with open(name + ".staged", "wb") as f:
                f.write(data)
        for name, _ in files:
            os.replace(name + ".staged", name)
    finally:
        for name, _ in files:
            if os.path.exists(name + ".staged"):
                os.remove(name + ".staged")


def _spooled(stack: ExitStack, near: str | None) -> str:
    """Standard input in a file, beside the output if there is one, as executors have to read it."""
    f = stack.enter_context(tempfile.NamedTemporaryFile(dir=os.path.dirname(os.path.abspath(near)) if near else None, prefix=".stdin-"))
    while part := sys.stdin.buffer.read(1 << 20):
        f.write(part)
    f.flush()
    return f.name


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("spanframe").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def run_bgzip(a: argparse.Namespace) -> dict:
    modes = [m for m in ("decompress", "test", "reindex") if getattr(a, m)]
    if len(modes) > 1:
        raise ValueError("decompress, test and reindex exclude one another")
    if (a.offset is not None or a.size is not None) and modes != ["decompress"]:
        raise ValueError("a range needs decompress")
    if a.size is not None and a.offset is None:
        raise ValueError("size needs offset")
    if a.index_input and a.offset is None:
        raise ValueError("an index to read needs offset")
    if a.index_output and modes not in ([], ["reindex"]):
        raise ValueError("an index is written when compressing and reindexing only")
    if modes and (a.level is not None or a.binary):
        raise ValueError("level and binary are for compressing")
    output = None if a.output == "-" else a.output
    guard_output(output, [a.input], a.force)
    with ExitStack() as stack:
        if a.input == "-":
            if a.reindex or a.offset is not None:
                raise ValueError("this needs a named input")
            source = _spooled(stack, output)
        else:
            source = a.input
        if not modes:
            return {"operation": "compress", "summary": _compress(stack, a, source, output)}
        f = stack.enter_context(open(source, "rb"))
        if a.test:
            from spanframe.sources.archive import verify

            return {"operation": "test", "summary": verify(source)}
        if a.reindex:
            if output and a.index_output:
                raise ValueError("reindexing writes one file")
            out = output or a.index_output or a.input + ".gzi"
            guard_output(out, [a.input], a.force)
            for _, member in checked(members(f)):
                inflate(member)
            blocks = manifest(f)
            _write([Gzi.of(blocks).to_bytes()], out)
            return {"operation": "reindex", "summary": {"blocks": len(blocks)}}
        if a.offset is not None:
            index = a.index_input or a.input + ".gzi"
            guard_output(output, [index], a.force)
            with open(index, "rb") as g:
                parts = [read_range(f, Gzi.parse(g.read()), a.offset, a.size)]
        elif output is not None:
            from spanframe.sources.splits import inflate_file

            return {"operation": "decompress", "summary": inflate_file(_spark(), source, output)}
        else:
            parts = (inflate(member) for _, member in checked(members(f)))
        return {"operation": "decompress", "summary": {"bytes_out": _write(parts, output)}}


def _compress(stack: ExitStack, a: argparse.Namespace, source: str, output: str | None) -> dict:
    """A named input without an output gets ``.gz`` beside it; standard input goes to standard output."""
    from spanframe.sources.archive import write_bgzf

    level = 6 if a.level is None else a.level
    if output is None and (a.input == "-" or a.output == "-"):
        folder = stack.enter_context(tempfile.TemporaryDirectory())
        summary = write_bgzf(_spark(), source, f"{folder}/out.gz", level, not a.binary, index=f"{folder}/out.gzi")
        if a.index_output:
            guard_output(a.index_output, [source], a.force)
            shutil.copyfile(f"{folder}/out.gzi", a.index_output + ".staged")
            os.replace(a.index_output + ".staged", a.index_output)
        with open(f"{folder}/out.gz", "rb") as f:
            _write(iter(lambda: f.read(1 << 20), b""), None)
        return summary
    if a.index_output:
        guard_output(a.index_output, [source], a.force)
    return write_bgzf(_spark(), source, output or a.input + ".gz", level, not a.binary, a.force, a.index_output)


def run_tabix(a: argparse.Namespace) -> dict:
    from spanframe.operators import native

    if a.action == "list":
        names = native.references(a.data, a.index)
        _write([(n + "\n").encode("latin-1") for n in names], a.output)
        return {"operation": "list", "summary": {"references": len(names)}}
    if a.action == "build":
        config = resolve(a.preset, sequence=a.sequence, begin=a.begin, end=a.end, zero_based=a.zero_based, comment=a.comment, skip=a.skip)
        if a.min_shift is not None and not a.csi:
            raise ValueError("a minimum shift needs --csi")
        guard_output(a.output, [a.data, a.data + ".gzi"], a.force)
        return {"operation": "build", "summary": native.build(_spark(), a.data, config, a.csi, a.min_shift or 14, a.output, a.force)}
    regions = read_region_file(a.regions_file) if a.regions_file else []
    regions += [parse_region(r) for r in a.regions]
    targets = read_region_file(a.targets_file) if a.targets_file else None
    if not regions and targets is None and not a.header_only:
        raise RegionError("nothing is asked for")
    sidecars = [a.index] if a.index else [a.data + ".tbi", a.data + ".csi"]
    guard_output(a.output, [x for x in (a.data, *sidecars, a.regions_file, a.targets_file) if x], a.force)
    spark, n = _spark(), 0

    def lines() -> Iterable[bytes]:
        nonlocal n
        if a.print_header or a.header_only:
            for line in native.header(a.data, native.find_index(a.data, a.index).config):
                n += 1
                yield (line + "\n").encode("latin-1")
        if not a.header_only:
            asked = regions if regions or a.regions_file else None
            found = native.query_file(spark, a.data, asked, targets, a.index, a.unique, a.separate_regions)
            for r in found.select("raw").toLocalIterator():
                n += 1
                yield (r["raw"] + "\n").encode("latin-1")

    size = _write(lines(), a.output)
    return {"operation": "query", "summary": {"lines": n, "bytes_out": size}}


def run_faidx(a: argparse.Namespace) -> dict:
    from spanframe.operators import sequence
    from spanframe.sources.fasta import fai_text, read_fai, read_fasta

    spark = _spark()
    if a.action == "build":
        out, gzi = a.output or a.reference + ".fai", a.gzi_output or a.reference + ".gzi"
        with open(a.reference, "rb") as f:
            packed = f.read(4) == b"\x1f\x8b\x08\x04"
        if a.gzi_output and not packed:
            raise ValueError("a block index needs a block-compressed reference")
        guard_output(out, [a.reference], a.force)
        if packed:
            guard_output(gzi, [a.reference, out], a.force)
            if os.path.abspath(gzi) == os.path.abspath(out):
                raise ValueError("both indexes have one name")
        lines = read_fasta(spark, a.reference)
        bad = sequence.stride_violations(lines).orderBy("ref_ordinal", "line_in_ref").first()
        if bad:
            raise FormatError(f"line {bad['line_in_ref']} of {bad['ref']} breaks the line length")
        text = fai_text(sequence.build_fai(lines))
        files, summary = [(out, text.encode())], {"sequences": text.count("\n"), "bases": sum(int(x.split("\t")[1]) for x in text.splitlines()), "compressed": packed}
        if packed:
            with open(a.reference, "rb", buffering=0) as f:
                index = Gzi.of(manifest(f, "reference"))
            files.append((gzi, index.to_bytes()))
            summary["gzi_entries"] = len(index.entries)
        _write_all(files)
        return {"operation": "build", "summary": summary}
    fai = read_fai(spark, a.fai or a.reference + ".fai")
    sequence.validate_fai(fai)
    lengths = {r["name"]: r["length"] for r in fai.toLocalIterator()}
    asked = []
    if a.region_file:
        with open(a.region_file, encoding="utf-8") as f:
            asked = [x.rstrip("\r\n") for x in f]
    asked += a.regions
    if not asked:
        raise RegionError("no region is asked for")
    sidecars = [a.fai or a.reference + ".fai", a.gzi or a.reference + ".gzi"]
    guard_output(a.output, [a.reference, *sidecars, a.region_file or a.reference], a.force)
    with open(a.reference, "rb") as f:
        packed = f.read(4) == b"\x1f\x8b\x08\x04"
    gzi = None
    if packed:
        with open(a.gzi or a.reference + ".gzi", "rb") as f:
            gzi = f.read()
    slices = sequence.slices_df(spark, [resolve_sequence(r, lengths) for r in asked])
    found = sequence.parts_indexed(spark, a.reference, fai, slices, gzi)
    rows = sequence.fasta_rows(slices, found, fai, a.length).orderBy("ordinal", "block").select("text").toLocalIterator()
    size = _write(((r["text"] + "\n").encode("latin-1") for r in rows), a.output)
    return {"operation": "query", "summary": {"regions": len(asked), "bytes_out": size}}


def run_dict(a: argparse.Namespace) -> dict:
    from spanframe.operators.sequence import dictionary_text
    from spanframe.sources.fasta import read_fasta

    guard_output(a.output, [a.reference], a.force)
    if a.reference == "-":
        handle, path = tempfile.mkstemp(suffix=".fa")
        with os.fdopen(handle, "wb") as f:
            f.write(sys.stdin.buffer.read())
        uri = a.uri
    else:
        path, uri = a.reference, a.uri or "file://" + os.path.realpath(a.reference)
    spark = _spark()
    text = dictionary_text(spark, read_fasta(spark, path), not a.no_header, alias=a.alias, uri=uri, assembly=a.assembly, species=a.species)
    _write([text.encode()], a.output)
    return {"operation": "dict", "summary": {"sequences": text.count("@SQ")}}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanframe")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("--json", action="store_true", help="report as JSON on standard output; data needs --output")
    commands = top.add_subparsers(dest="command", required=True)

    def common(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
        p.add_argument("-o", "--output")
        p.add_argument("-f", "--force", action="store_true")
        p.add_argument("-@", "--threads", type=int, help="accepted; Spark decides")
        return p

    p = common(commands.add_parser("bgzip"))
    p.add_argument("input", nargs="?", default="-", help="a file; - or nothing for standard input")
    p.add_argument("-d", "--decompress", action="store_true")
    p.add_argument("-t", "--test", action="store_true")
    p.add_argument("-r", "--reindex", action="store_true")
    p.add_argument("-l", "--level", "--compress-level", type=int)
    p.add_argument("--index-output", help="the block index that compressing or reindexing writes")
    p.add_argument("--binary", action="store_true")
    p.add_argument("--index-input")
    p.add_argument("-b", "--offset", type=int)
    p.add_argument("-s", "--size", type=int)
    p.set_defaults(run=run_bgzip)

    tabix = commands.add_parser("tabix").add_subparsers(dest="action", required=True)
    p = common(tabix.add_parser("build"))
    p.add_argument("data")
    p.add_argument("-p", "--preset", choices=("bed", "gff", "sam", "vcf"))
    p.add_argument("-s", "--sequence", type=int)
    p.add_argument("-b", "--begin", type=int)
    p.add_argument("-e", "--end", type=int)
    p.add_argument("-0", "--zero-based", action="store_true")
    p.add_argument("-c", "--comment")
    p.add_argument("-S", "--skip", type=int)
    p.add_argument("-C", "--csi", action="store_true")
    p.add_argument("-m", "--min-shift", type=int)
    p.set_defaults(run=run_tabix)
    p = common(tabix.add_parser("query"))
    p.add_argument("data")
    p.add_argument("regions", nargs="*")
    p.add_argument("-i", "--index")
    p.add_argument("-R", "--regions-file")
    p.add_argument("-T", "--targets-file")
    for name in ("--print-header", "--header-only", "--unique", "--separate-regions"):
        p.add_argument(name, action="store_true")
    p.add_argument("--cache-bytes", type=int, help="accepted; not used")
    p.set_defaults(run=run_tabix)
    p = common(tabix.add_parser("list"))
    p.add_argument("data")
    p.add_argument("-i", "--index")
    p.set_defaults(run=run_tabix)

    faidx = commands.add_parser("faidx").add_subparsers(dest="action", required=True)
    p = common(faidx.add_parser("build"))
    p.add_argument("reference")
    p.add_argument("--gzi-output", help="the block index of a block-compressed reference; beside it if not given")
    p.set_defaults(run=run_faidx)
    p = common(faidx.add_parser("query"))
    p.add_argument("reference")
    p.add_argument("regions", nargs="*")
    p.add_argument("--fai")
    p.add_argument("--gzi")
    p.add_argument("-r", "--region-file")
    p.add_argument("-n", "--length", type=int)
    p.set_defaults(run=run_faidx)

    p = common(commands.add_parser("dict"))
    p.add_argument("reference")
    p.add_argument("-A", "--alias", action="store_true")
    p.add_argument("-H", "--no-header", action="store_true")
    p.add_argument("-a", "--assembly")
    p.add_argument("-s", "--species")
    p.add_argument("-u", "--uri")
    p.set_defaults(run=run_dict)
    return top


def main(argv: Sequence[str] | None = None) -> int:
    """Exit 0, or 1 with a message; bad arguments exit 2."""
    a = parser().parse_args(argv)
    try:
        if a.json and a.output is None and not (a.command == "bgzip" and (a.test or a.reindex)):
            raise ValueError("--json needs --output for the data")
        report = a.run(a)
    except (FormatError, RegionError, BlockError, ValueError, OSError) as e:
        if a.json:
            print(json.dumps({"status": "error", "command": a.command, "message": str(e)}))
        else:
            print(f"spanframe: {e}", file=sys.stderr)
        return 1
    if a.json:
        print(json.dumps({"status": "ok", "command": a.command, "report": report}))
    return 0


if __name__ == "__main__":
    sys.exit(main())
