"""Scripts and Java whose declarations, strings, templates and comments go over lines, against lists written by hand."""

import pytest

from graphwright.sources import braces, symbols

SCRIPT = r"""/* function hidden(a) { class Gone {} }
   import no from 'nowhere'; */
import {
  one as first, // not two: call(this)
  two,
} from './parts';
import * as all from "all";
import 'side/effect.css';
const text = "function inString(x) { open( }", other = 'it\'s class Fake { go() { run(1) } }';
const pattern = /function\s+fake\((["'`])/g, half = total / 2 / count(3);
const page = `
  class Shown { method() {} }
  ${render(`inner ${deep(1)} text`, { a: { b: 2 } })} and ${label}
  function no() {
`;
export const wide = async (
  left,
  right = fallback(1),
  { a, b },
  ...rest
) => {
  return left.map((x) => x.then(done)).catch(handle);
};
export default class Board
  extends Base {
  constructor(
    size,
    name,
  ) {
    super(size);
    const inner = { nested(v) { return keep(v); } };
    if (size) { this.draw(size); }
  }

  static async *walk(from, to) { for (const x of from) { yield step(x, to); } }
  get area() { return new Shape(size).area(); }
}
const after = { alone(y) { return Upper(y); } };
function plain(a, b) { return wide(a, b) }
function* generated() { }
"""
TYPED = r"""import type { Props } from './types';
import React, { useState as state } from 'react';
interface Reader extends Closed {
  read(count: number): string;
}
@Injectable({ providedIn: 'root' })
export abstract class Service<T extends object>
  extends Repository<T, Map<string, number>>
  implements OnInit, Loader<T>, Disposable {
  constructor(
    private readonly http: Http,
    @Inject(TOKEN) public token?: string,
  ) {
    super();
  }
  abstract load(id: string, options?: { deep: boolean, at: [number, number] }): Promise<T>;
  @Input()
  public async find<K>(
    key: K,
    compare: (a: T, b: T) => number = (a, b) => order(a, b),
    ...more: string[]
  ): Promise<{ found: T }> {
    // return this.http.get(`${base}/x`);
    return this.http?.get<T>(`${url(key)}/${
      encode(key)}`);
  }
}
export function overload(a: string): void;
export function overload(a: any) { }
const typed: (n: number) => void = (n: number): void => { use(n) };
const View = <P,>(props: P) => <div title="don't">{items.map((i) => show(i))}</div>;
"""
JAVA = r'''package a.b;

import java.util.Map;
import java.util.concurrent.*;
import static org.junit.Assert.assertTrue;

/**
 * class Comment { void no() {} }
 */
@Table(name = "x { y")
public final class Store<K extends Comparable<K>, V>
    extends Base
    implements Closeable, Comparable<Store<K, V>>, Runnable {

  private static final String TEXT = """
      class Quoted { void no(int x) { call(x); } }
      "still" \""" text
      """;
  private final char brace = '{', quote = '"', tick = '\'';

  public Store(
      int size, // the size ( of it
      final Map<K, V> start) throws IOException,
      TimeoutException {
    super(size);
    this.fill(start);
  }

  @Override
  @SuppressWarnings({"unchecked", "raw"})
  public <T> Map<K, List<T>> find(
      Map<K, V> in,
      /* int gone, */
      int[] counts,
      String... names) {
    Runnable r = new Runnable() { public void run() { go(1); } };
    String s = "void fake(int y) {" + Text.of(in);
    if (size > 1) { return Helper.find(in); } else return other(in);
  }

  protected abstract int total(int a);
  class Inner { Inner(int q) { } void inside() { } }
}

interface Shape extends Plain, Thing {
  double area(double scale);
  default String name() { return label(); }
}

enum Kind implements Named {
  ROUND(1) { int sides() { return 0; } }, FLAT(2);
  private final int n;
  Kind(int n) { this.n = n; }
}

@interface Marked { int value() default 3; }
'''


@pytest.fixture(scope="module")
def found(spark):
    rows = [("a.js", "javascript", SCRIPT), ("b.ts", "typescript", TYPED), ("C.java", "java", JAVA), ("empty.js", "javascript", ""), ("null.ts", "typescript", None), ("open.js", "javascript", "function a(b) { /* never closed {\n `"), ("open.java", "java", 'class A { String s = "x')]
    files = spark.createDataFrame([(p, p, language, text, None) for p, language, text in rows], "path string, rel_path string, language string, text string, error string")
    return symbols.extract(files).collect()


def of(found, path, kind, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in sorted((r for r in found if r["path"] == path and r["kind"] == kind), key=lambda r: r["line"])]


def test_script(found):
    assert of(found, "a.js", "function", "name", "line", "params") == [
        ("wide", 16, ["left"]), ("constructor", 26, ["size", "name"]), ("nested", 31, ["v"]), ("walk", 35, ["from", "to"]), ("area", 36, []), ("alone", 38, ["y"]), ("plain", 39, ["a", "b"])]
    assert of(found, "a.js", "class", "name", "line", "methods") == [("Board", 24, ["constructor", "walk", "area"])]
    assert of(found, "a.js", "inheritance", "name", "bases") == [("Board", ["Base"])]
    assert of(found, "a.js", "import", "module", "names") == [("./parts", ["one", "two"]), ("all", ["all"]), ("side/effect.css", [])]
    assert sorted(of(found, "a.js", "call", "name")) == sorted(["count", "render", "deep", "fallback", "map", "then", "catch", "keep", "draw", "step", "area", "wide"])


def test_typescript(found):
    assert of(found, "b.ts", "function", "name", "params") == [
        ("constructor", ["http", "token"]), ("load", ["id", "options"]), ("find", ["key", "compare"]), ("overload", ["a"]), ("typed", ["n"]), ("View", ["props"])]
    assert of(found, "b.ts", "class", "name", "line", "methods") == [("Reader", 3, []), ("Service", 7, ["constructor", "find"])]
    assert of(found, "b.ts", "inheritance", "name", "bases") == [("Service", ["Repository", "OnInit", "Disposable"])]
    assert of(found, "b.ts", "import", "module", "names") == [("./types", ["Props"]), ("react", ["React", "useState"])]
    assert sorted(of(found, "b.ts", "call", "name")) == sorted(["order", "get", "url", "encode", "use", "map", "show"])


def test_java(found):
    assert of(found, "C.java", "function", "name", "params") == [
        ("Store", ["size", "start"]), ("find", ["in", "counts"]), ("run", []), ("total", ["a"]), ("Inner", ["q"]), ("inside", []), ("area", ["scale"]), ("name", []), ("sides", []), ("Kind", ["n"])]
    assert of(found, "C.java", "class", "name", "line", "methods") == [("Store", 11, ["Store", "find", "total"]), ("Inner", 42, ["Inner", "inside"]), ("Shape", 45, []), ("Kind", 50, [])]
    assert of(found, "C.java", "inheritance", "name", "bases") == [("Store", ["Base", "Closeable", "Runnable"])]
    assert of(found, "C.java", "import", "module", "names") == [("java.util", ["Map"]), ("java.util.concurrent", ["*"]), ("org.junit.Assert", ["assertTrue"])]
    assert sorted(of(found, "C.java", "call", "name")) == sorted(["fill", "go", "of", "find", "other", "label"])


def test_open_ends(found):
    assert of(found, "open.js", "function", "name", "params") == [("a", ["b"])]
    assert of(found, "open.java", "class", "name") == ["A"]
    assert not [r for r in found if r["path"] in ("empty.js", "null.ts")]


def test_long_tokens_need_no_deep_stack(spark):
    """Loops of the patterns are no recursion: tokens of a million characters with escapes pass."""
    body = "var s = '" + "\\n" * 500_000 + "';\n/* " + "* x\n" * 100_000 + "*/\nvar t = `" + "a$b${c(1)}" * 50_000 + "`;\n" + "{" * 3000 + "}" * 3000 + "\nfunction last(a,\n b) { end(" + "1," * 100_000 + "2) }\n"
    files = spark.createDataFrame([("l.js", "l.js", "javascript", body)], "path string, rel_path string, language string, text string")
    rows = braces.symbols(files, "script").filter("kind = 'function' or name = 'end'").collect()
    assert {(r["kind"], r["name"], r["line"]) for r in rows} >= {("function", "last", 100_005), ("call", "end", 100_006)}
