"""convert INPUT... --output DIR"""

from __future__ import annotations

import argparse
import json
import sys

from docloom.plans.job import Options, Rejected, run_job


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docloom")
    convert = parser.add_subparsers(dest="command", required=True).add_parser("convert")
    convert.add_argument("inputs", nargs="+")
    convert.add_argument("--output", required=True)
    convert.add_argument("--json", action="store_true")
    convert.add_argument("--zip-name")
    convert.add_argument("--max-files", type=int, default=Options.max_files)
    convert.add_argument("--max-file-size-mb", type=int, default=Options.max_file_size_bytes >> 20)
    convert.add_argument("--recursive", action="store_true")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("docloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    options = Options(max_files=args.max_files, max_file_size_bytes=args.max_file_size_mb << 20, recursive=args.recursive, zip_name=args.zip_name)
    try:
        result = run_job(spark, args.inputs, args.output, options)
    except Rejected as e:
        print(json.dumps({"status": "validation_error", "exit_code": e.exit_code, "error_code": e.code, "error": str(e)}, indent=2) if args.json else str(e), file=sys.stderr)
        return e.exit_code
    except Exception as e:  # noqa: BLE001  reported to the caller as exit code 4
        print(json.dumps({"status": "failed", "exit_code": 4, "error": str(e)}, indent=2) if args.json else str(e))
        return 4
    if args.json:
        print(json.dumps(result, indent=2, ensure_ascii=False))
    else:
        for key, value in result["summary"].items():
            print(f"{key}: {value}")
        print(f"folder: {result['output_folder']}\narchive: {result['export_zip']}")
    return result["exit_code"]


if __name__ == "__main__":
    sys.exit(main())
