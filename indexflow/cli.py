"""Command line: python -m indexflow.cli COMMAND APP, where APP is a module or file that defines flows, maybe with :flow."""

from __future__ import annotations

import argparse
import importlib
import importlib.util
import json
import sys

from indexflow import flow as flows


def load_app(target: str) -> str | None:
    """Import the app; the name of the flow after the colon, if there is one."""
    app, _, name = target.partition(":")
    if app.endswith(".py"):
        spec = importlib.util.spec_from_file_location("indexflow_app", app)
        module = importlib.util.module_from_spec(spec)
        sys.modules["indexflow_app"] = module
        spec.loader.exec_module(module)
    else:
        sys.path.insert(0, ".")
        importlib.import_module(app)
    return name or None


def chosen(name: str | None) -> list[flows.Flow]:
    return [flows.flow_by_name(name)] if name else list(flows.flows().values())


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="indexflow")
    sub = parser.add_subparsers(dest="command", required=True)
    for command, text in (("ls", "list flows"), ("show", "show a flow's spec and schema"), ("setup", "make targets as flows want them"), ("drop", "drop targets and state"), ("update", "bring targets up to date"), ("evaluate", "write what sources produce, touching no target"), ("server", "answer requests over HTTP")):
        p = sub.add_parser(command, help=text)
        p.add_argument("app")
        if command in ("setup", "drop"):
            p.add_argument("-f", "--force", action="store_true", help="don't ask")
        if command == "update":
            p.add_argument("-L", "--live", action="store_true", help="go on until stopped")
            p.add_argument("--setup", action="store_true", help="set targets up first")
            p.add_argument("-q", "--quiet", action="store_true")
        if command == "evaluate":
            p.add_argument("-o", "--output-dir", default="eval")
            p.add_argument("--no-cache", action="store_true")
        if command == "server":
            p.add_argument("-a", "--address", default="127.0.0.1:49344")
            p.add_argument("-c", "--cors-origin", action="append", default=[])
    args = parser.parse_args(argv)
    name = load_app(args.app)
    if args.command == "ls":
        for f in chosen(name):
            print(f.full_name)
    elif args.command == "show":
        for f in chosen(name):
            print(json.dumps({"flow": f.full_name, "spec": f.spec(), "schema": f.schema()}, indent=2, default=str))
    elif args.command in ("setup", "drop"):
        for f in chosen(name):
            print(f"{f.full_name}:\n{flows.describe_steps(f.setup_steps()) if args.command == 'setup' else 'drop all targets and state'}")
        if not args.force and input("Go on? [yes/N] ") != "yes":
            return 1
        for f in chosen(name):
            f.setup() if args.command == "setup" else f.drop()
    elif args.command == "update":
        from indexflow.streaming.live import FlowLiveUpdater, FlowLiveUpdaterOptions

        for f in chosen(name):
            if args.setup:
                f.setup()
            with FlowLiveUpdater(f, FlowLiveUpdaterOptions(live_mode=args.live, print_stats=not args.quiet)) as updater:
                updater.wait()
    elif args.command == "evaluate":
        for f in chosen(name):
            n = f.evaluate_and_dump(flows.EvaluateAndDumpOptions(args.output_dir, not args.no_cache))
            print(f"{f.full_name}: {n} files in {args.output_dir}")
    else:
        from indexflow.service import serve

        host, _, port = args.address.rpartition(":")
        serve(host or "127.0.0.1", int(port), tuple(args.cors_origin)).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
