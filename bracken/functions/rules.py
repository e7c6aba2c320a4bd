"""Which imports of a pickle are dangerous, unsafe or dual-use, as columns over (module, name)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Names of each module that run code, start processes or load modules.
SINKS = {
    "os": "system popen execl execvp execv execve spawnl spawnv",
    "subprocess": "Popen call check_call check_output run getoutput getstatusoutput",
    "builtins": "eval exec compile open __import__ breakpoint input",
    "posix": "system popen execv spawnv",
    "nt": "system popen execv spawnv",
    "webbrowser": "open open_new open_new_tab get",
    "socket": "socket connect create_connection",
    "bdb": "Bdb run runeval runcall runctx",
    "pdb": "Pdb run runeval runcall set_trace post_mortem",
    "asyncio": "create_subprocess_shell create_subprocess_exec run get_event_loop new_event_loop SelectorEventLoop",
    "asyncio.unix_events": "_UnixSubprocessTransport _UnixDefaultEventLoopPolicy SelectorEventLoop",
    "asyncio.base_events": "BaseEventLoop",
    "asyncio.base_subprocess": "BaseSubprocessTransport",
    "asyncio.subprocess": "create_subprocess_shell create_subprocess_exec",
    "asyncio.events": "get_event_loop new_event_loop",
    "pip": "main",
    "pip._internal": "main",
    "pip._internal.cli.main": "main",
    "setuptools": "setup",
    "pty": "spawn fork openpty",
    "platform": "popen _syscmd_ver",
    "multiprocessing": "Process Pool",
    "importlib": "import_module reload __import__",
    "importlib.util": "spec_from_file_location module_from_spec",
    "importlib.machinery": "SourceFileLoader ExtensionFileLoader",
    "imp": "load_source load_module load_dynamic load_compiled",
    "runpy": "run_path run_module _run_code _run_module_code",
    "pkgutil": "get_loader find_loader",
    "sys": "modules settrace setprofile _getframe exit",
    "code": "interact InteractiveInterpreter InteractiveConsole compile_command",
    "codeop": "compile_command Compile CommandCompiler",
    "timeit": "timeit repeat Timer",
    "cProfile": "run runctx Profile",
    "profile": "run runctx Profile",
    "ctypes": "CDLL cdll WinDLL windll PyDLL LibraryLoader CFUNCTYPE",
    "dill._dill": "_create_function _create_code _import_module _get_attr",
    "dill": "loads load",
}
# Modules all of whose submodules count, attributes that run something, attributes that lead out of an object.
FAMILIES = "asyncio importlib pip ctypes multiprocessing".split()
EXECUTING = (
    "system popen spawn spawnl spawnv fork forkpty exec execv execl execfile eval compile run runeval runcall runctx run_path run_module "
    "call check_call check_output getoutput getstatusoutput Popen check_response import_module __import__ load_module load_source load_dynamic interact compile_command"
).split()
ESCAPING = "__class__ __bases__ __base__ __mro__ __subclasses__ __globals__ __builtins__ __import__ __init__ __code__ __reduce__ __getattribute__ __dict__ __func__ __self__ __module__ __loader__ __spec__".split()
# Modules and builtins that strict mode lets through; builders of callables from a name.
SAFE_MODULES = (
    "torch numpy collections builtins copyreg __builtin__ typing datetime pathlib posixpath ntpath re copy functools operator warnings contextlib abc enum dataclasses types _operator complex "
    "decimal fractions uuid numbers array struct math itertools string joblib.numpy_pickle dill"
).split()
SAFE_BUILTINS = "getattr setattr bytearray dict list set tuple slice frozenset range complex bool int float str bytes object".split()
BUILTINS = ["builtins", "__builtin__"]
DUAL_USE = [(m, n) for m in ("operator", "_operator") for n in ("methodcaller", "attrgetter")]


def ancestors(module: Column) -> Column:
    """The dotted module and its ancestors, longest first."""
    parts = F.split(F.coalesce(module, F.lit("")), r"\.")
    return F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def dangerous(module: Column, name: Column) -> Column:
    """Whether a pair, or the name under an ancestor of its module, is a sink; an executing name in a family is one."""
    pairs = _strings([f"{m} {n}" for m, names in SINKS.items() for n in names.split()])
    up = ancestors(module)
    listed = F.arrays_overlap(F.transform(up, lambda m: F.concat_ws(" ", m, name)), pairs)
    family = F.arrays_overlap(up, _strings(FAMILIES)) & name.isin(EXECUTING)
    return F.coalesce((module != "") & (name != "") & (listed | family), F.lit(False))


def safe(module: Column, name: Column) -> Column:
    """Whether strict mode lets an import through."""
    known = F.filter(ancestors(module), lambda m: m.isin(SAFE_MODULES))
    first = F.try_element_at(known, F.lit(1))
    allowed = F.when(first.isNull(), (module == "_codecs") & name.isin("encode", "decode")).when(first.isin(BUILTINS), name.isin(SAFE_BUILTINS)).otherwise(True)
    shaped = name.isin(EXECUTING) & ~module.isin(BUILTINS)
    return F.coalesce((module != "") & ~dangerous(module, name) & ~shaped & allowed, F.lit(False))


def dual_use(module: Column, name: Column) -> Column:
    out = F.lit(False)
    for m, n in DUAL_USE:
        out = out | ((module == m) & (name == n))
    return F.coalesce(out, F.lit(False))


def dangerous_argument(argument: Column) -> Column:
    """Whether a dotted part of a name given to a dual-use builder runs something or leads out of its object."""
    return F.coalesce(F.arrays_overlap(F.split(argument, r"\."), _strings(EXECUTING + ESCAPING)), F.lit(False))


def threats(found: Column, strict: Column) -> Column:
    """Distinct labels, in order, of ARRAY<STRUCT<module, name, args, via>> of imports.

    Salvaged imports are judged by the sinks alone, in either mode; they do not repeat a label.
    """

    def label(g: Column) -> Column:
        text = F.concat_ws(".", g["module"], g["name"])
        bad = F.filter(g["args"], dangerous_argument)
        shown = F.when(F.size(bad) > 0, F.concat(text, F.lit("('"), F.try_element_at(bad, F.lit(1)), F.lit("')"))).otherwise(text)
        walked = g["via"] == "walk"
        risky = F.when(~walked, dangerous(g["module"], g["name"])).when(dual_use(g["module"], g["name"]), F.size(bad) > 0)
        risky = risky.otherwise(F.when(strict, ~safe(g["module"], g["name"])).otherwise(dangerous(g["module"], g["name"])))
        return F.when(risky, F.when(strict, F.concat(F.lit("UNSAFE_IMPORT: "), shown)).otherwise(shown))

    return F.array_distinct(F.filter(F.transform(found, label), lambda t: t.isNotNull()))
