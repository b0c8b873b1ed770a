"""Short texts that the grammars have to accept (GOOD) and to reject (BAD)."""

GOOD = {
"java": [
 "sealed interface S permits A {}\n", "class A { int f(Object o) { return switch (o) { case Integer i -> 1; case String s when s.length() > 1 -> 2; case null, default -> 0; }; } }",
 "class A { void f(List<? super T> a) { } }", "class A { boolean f(Object o) { return o instanceof B b && b.x; } }", "module a.b { requires java.base; exports a.b.c to d.e; uses x.Y; provides p.Q with r.S, t.U; }\n",
 "record P(int x, int y) { P { if (x < 0) throw new E(); } static int z = 1; }", "class A { int x = o instanceof P(int a, var b) ? a : 1; }",
 "class A<T extends Comparable<? super T>> { <R> R f(Function<? super T, ? extends R> g) { return g.apply(null); } }",
 "class A { void f() { label: for (;;) { break label; } do { x++; } while (x < 3); synchronized (this) { y(); } } }",
 "class A { int[] a = {1, 2}, b[] = {{1}}; long l = 0xFFL; char c = '\\u0041'; String s = \"\"\"\n  a \"b\"\n  \"\"\"; }",
 "@interface N { int value() default 3; String[] x() default {}; }", "enum E { A(1) { int f() { return 1; } }, B; E() {} E(int x) {} }",
 "class A { Supplier<A> s = A::new; IntFunction<int[]> t = int[]::new; Runnable r = () -> {}; }",
 "class A { int f(int d) { switch (d) { case 1: case 2: return 3; default: break; } int x = switch (d) { case 1 -> { yield 2; } default -> throw new E(); }; return x; } }",
 "class A { void f() throws E, F { try (var r = g(); var t = h()) { } catch (E | F e) { } finally { } } non-sealed class B {} }",
 "class A { void f() { var x = new HashMap<String, List<Integer>>() {{ put(1, null); }}; int y = (int) 3.5f; Object o = (Runnable & Serializable) () -> {}; } }",
 "class Outer { class I { void g() { Outer.this.f(); Outer.super.toString(); outer.new Inner(); } } }",
 "import static a.b.C.*;\nclass A { @Override public final synchronized native void f(); int g(final @N int... x) { assert x > 1 : \"m\"; return ~x[0] >>> 2; } }",
 "class A { boolean b = a < b && c > d; int i = a < 3 ? b : c; boolean e = (x < y) == (z >= w); }",
],
"typescript": [
 "type M<T> = { readonly [K in keyof T]?: T[K] };\n", "declare module \"x\" { export const a: number; export function f(): void; }\n", "const f = <T,>(y: T) => y;\n",
 "type N = [a: string, b?: number, ...rest: boolean[]];\n", "declare const s: unique symbol;\n", "type C = new (a: any) => T;\n", "type D<T> = T extends (infer U)[] ? U : never;\n",
 "abstract class A<T> implements B, C<T> { private readonly x: number = 1; constructor(public a: string, protected b?: number) { super(); } abstract f(): void; static #p = 3; get y(): number { return 1; } declare z: string; }\n",
 "function isS(x: unknown): x is string { return typeof x === 'string'; }\n", "function assert(x: unknown): asserts x is string {}\n", "let x = y as const; let z = <any>y; let w = a!.b!.c;\n",
 "export type { A } from './a'; import type { B } from './b'; export * as ns from 'c'; import x = require('x');\n", "enum E { A = 1 << 2, B = A | 3 }\nconst enum F { X = 'a' }\n",
 "type T1 = `a-${string}`; type T2 = keyof typeof obj; type T3 = A['b'][number]; type T4 = readonly string[];\n", "function f(this: Window, a?: number, ...r: string[]): void {}\nfunction f2(x: string): string;\nfunction f2(x: any) { return x; }\n",
 "namespace A.B { export const x = 1; }\ndeclare global { interface Window { a: string } }\n", "class A { @Input() x: string; @Output() y = new EventEmitter<string>(); @HostListener('a', ['$event']) f(e) {} }\n",
 "const a = b satisfies C; const c = d?.e?.[0]?.(f) ?? g; x ||= 1; y ??= 2;\n", "interface I { (x: number): string; new (x: string): I; readonly [k: string]: any; m?(): void; get a(): number; }\n",
 "type G = A & { b: string } | (() => void) | null; let f: (a: number, b?: string) => Promise<void>;\n", "for (const [k, v] of Object.entries(x)) { if (k in y) continue; }\nlabel: while (true) { break label; }\n",
 "let t: typeof import('./a'); let u = import('./b'); export default abstract class {}\n", "const g = async <T extends object>(x: T): Promise<T> => { await x; return x; };\n", "type R = -1 | 'a' | true; type O = { a: string, b?: number; c(): void };\n",
 "let a = x < y && z > w; const m = new Map<string, number[]>(); f<number>(3); const {a: b = 1, ...c} = d;\n",
 "type Mp = { [K in A as `get${K}`]-?: T[K] };\nabstract class Q { protected abstract readonly x: number; static { init(); } accessor y = 1; }\n",
],
"javascript": [
 "class A { async *gen(){ yield* x; } static async f() {} #p = 1; static { a(); } get [k]() { return 1 } 'q'() {} 3() {} }\n", "function* g() { const x = yield; yield a; yield* b; }\n",
 "const {a, b: {c = 1} = {}, ...d} = e; [x, , y = 2, ...z] = w;\n", "for await (const x of y) {}\nfor (let i = 0, j = 1; i < j; i++, j--) ;\n", "export default function () {}\n", "export default class extends A {}\n", "export { a as b, default as c } from 'd'; export * from 'e'; import f, { g as h } from 'i'; import * as j from 'k'; import 'l';\n",
 "var f = async x => await x, g = (a, b = 1, ...c) => ({ a }), h = async () => {};\n", "switch (a) { case 1: case 2: b(); break; default: c() }\n", "a?.b?.[c]?.(d); x ??= y; z **= 2; v = 1_000n; if (a) b; else if (c) d; else { e }\n",
 "const o = { get a() { return 1 }, set a(v) {}, async b() {}, *c() {}, [d]: 1, 'e': 2, 3: 4, f, ...g, async *h() {} };\n", "new.target; import.meta.url; new A; new A.B(c); delete a.b, void 0; typeof x === 'y'\n", "do { x() } while (y)\nlabel: for (;;) { continue label }\n",
 "try { a() } catch { b() }\n", "var a = b ? c : d ? e : f, r = /[/\\]]+/gi.test(x), t = tag`a${b}c`;\n", "if (a) { } else b()\nx = function () { return }\n!function () {}();(function(){})()\n", "let async = 1, of = 2, get = 3; async = of + get;\n", "'use strict'\nvar a = 1\n++a\nthrow new Error('x')\n", "while(a)b();with_(c);debugger;\n",
 "export const a = 1, b = 2\nexport let c\nexport var d;\nlet e = class { f = 1; g; static h = 2 };\n", "x = a /b/ c; y = (a) / 2; z = a++ / 2; w = [1] / 2\n",
],
"rust": [
 "macro_rules! m { ($x:expr) => { $x }; ($($y:ident),* $(,)?) => { $(let $y = 1;)* }; }\n", "fn f() { 'a: loop { break 'a 1; } }\n", "union U { a: u32, b: f32 }\n", "extern \"C\" { fn printf(f: *const u8, ...) -> i32; static X: i32; }\n",
 "fn f<T: Clone + 'static, const N: usize>(a: [T; N]) -> impl Iterator<Item = T> where T: Into<String> { a.into_iter() }\n", "async fn g() -> Result<(), Box<dyn Error + Send>> { h().await?; let c = async move { 1 }; Ok(()) }\n",
 "fn f() { if let Some(x) = y && x > 1 { } while let Some((a, b)) = it.next() { } let Some(q) = r else { return; }; }\n", "fn f() { match x { 1..=5 | 7 => {}, n @ 8.. => (), Foo::Bar { a, ref b, .. } if a > 1 => return, [first, .., last] => 1, _ => unreachable!(\"x {}\", y) } }\n",
 "impl<T> Trait for Vec<T> where T: Fn(i32) -> bool { type Out = T; const X: u8 = b'a'; fn f(&mut self, mut x: i32) -> &'_ str { r#\"a\"b\"# } }\n", "pub(crate) trait A: B + C { type T: D; fn f(self: Box<Self>) where Self: Sized; const N: usize = 3; }\n", "#![allow(x)]\n//! doc\nuse a::{b as c, d::*, self};\npub use crate::e;\nmod f;\nextern crate g;\n",
 "fn f() { let x = vec![1, 2]; let y = &x[1..]; let z = |a: i32| -> i32 { a + 1 }; let w = move || x; println!(\"{:?}\", y as *const _); }\n", "struct A(pub i32, String); struct B; struct C<'a, T = i32> where T: 'a { x: &'a T }\n", "enum E { A = 1, B { x: i32 }, C(i32, i32) }\n", "unsafe impl Send for A {}\nunsafe fn f() { *p = 1; }\n", "const fn f() {} static mut X: [u8; 3] = [0; 3]; type F = fn(i32, &str) -> Option<()>;\n",
 "fn f() { let a = if x { 1 } else { 2 }; let b = loop { break 3 }; let c = unsafe { g() }; let d = Struct { a, b: 1, ..Default::default() }; let e = <T as Trait>::f(); let g = x as u8 < 3; let h = !-1; a += 1; b <<= 2; }\n", "fn f() { for (i, x) in y.iter().enumerate().filter(|(_, z)| **z > 1) { continue; } let t = (1,); let c = '\\u{1F600}'; let n = 1_000u64; let f = 1.5e3; let r#type = 1; return; }\n",
 "impl<F> A<F> where for<'a> F: Fn(&'a str) -> &'a str {} fn g(f: &dyn for<'a> Fn(&'a u8)) {} fn h(x: &mut (dyn A + 'static)) {}\n", "fn f() -> ! { loop {} } fn g() { let x: [[u8; 2]; 3]; let y = [0u8; 4]; x[0][1] = y.0.1; }\n", "macro_rules! v { () => {} }\nthread_local! { static X: u8 = 1; }\n",
],
"go": [
 "package a\nfunc f[T any, U ~int|~string](x T) {}\n", "package a\ntype S[T comparable] struct { x T; *B; C `json:\"c\"` }\nfunc (s *S[T]) M() (a int, err error) { return }\n", "package a\nfunc f() { switch x := y.(type) { case int, string: g(); case nil: default: }; select { case v := <-c: _ = v; case c <- 1: default: } }\n",
 "package a\nvar ( x, y = 1, 2\n z map[string][]int = map[string][]int{\"a\": {1, 2}} )\nconst ( A = iota\n B )\n", "package a\nfunc f() { for i := range 10 { } ; for k, v := range m { } ; for { break } ; L: for ; ; { continue L } ; goto L }\n", "package a\ntype I interface { M(int) string; fmt.Stringer; ~int | ~string }\ntype F func(a, b int, c ...string) (int, error)\ntype A = B\n",
 "package a\nfunc f() { defer func() { recover() }(); go g(); ch := make(chan<- int, 3); a, ok := x.(T); if v, ok := m[k]; ok { } else if z { } else { } }\n", "package a\nvar x = []struct{ a int; b string }{{1, \"a\"}, {a: 2}}\nvar y = [...]int{1, 2: 3}\nvar z = &T{a: 1}\nvar w = a[1:2:3]\nvar f = func(x int) int { return x * 2 }\n", "package a\nimport . \"x\"\nimport _ \"y\"\nimport ( z \"w\"; \"v\" )\nfunc init() {}\n",
 "package a\nfunc Map[T, U any](s []T, f func(T) U) []U { r := make([]U, 0, len(s)); for _, x := range s { r = append(r, f(x)) }; return r }\nvar q = Map[int, string](nil, nil)\n", "package a\nfunc f() { x.y.z(); *p = 1; a[i], b = b, a[i]; c <<= 2; d &^= e; i++; var r rune = 'é'; s := `raw`; _ = 0x1p-2 + 1i + 0b11; fallthrough_() }\n",
 "package a\nfunc f() {\n\tswitch {\n\tcase x > 1:\n\t\tfallthrough\n\tdefault:\n\t}\n\tif err := g(); err != nil {\n\t\treturn\n\t}\n\ttype t struct{}\n\tconst c = 1\n}\n",
],
"c": [
 "__attribute__((noreturn)) void f(void);\n", "_Static_assert(sizeof(int) == 4, \"x\");\n", "int f(int x) { return _Generic(x, int: 1, default: 2); }\n", "void f(void) { asm volatile(\"nop\" : \"=r\"(a) : \"r\"(b) : \"memory\"); __asm__(\"x\"); }\n", "int (*(*p)[3])(int);\n",
 "typedef int (*cb)(void *, size_t); typedef struct node { struct node *next; union { int a; float b; } u; unsigned f : 3; } node_t;\n", "static const struct ops o = { .open = f, .x = { [0] = 1, [1] = 2 }, };\n", "int main(int argc, char **argv) { for (;;) { if (x) continue; else break; } do { y(); } while (0); switch (z) { case 1: { } case 'a': break; default: ; } goto end; end: return 0; }\n",
 "#define M(a, b) \\\n  do { a; } while (0)\n#ifdef X\nint x;\n#else\nint y;\n#endif\nextern int z, *w[3], (*fp)(int, ...);\n", "void f(int n, int a[static n], const char *restrict s, ...) { int v[n]; char *p = (char *)s + 1, c = *p++; struct s t = (struct s){ 1, 2 }; x->y.z[1] = sizeof(int) * sizeof x; a ? b : c, d; }\n", "inline static unsigned long long f(void) { return 0xFFULL; } enum e { A, B = 3, } e; _Bool b; int (f)(void); char s[] = \"a\" \"b\"; wchar_t c = L'x';\n", "int f(a, b) int a; char *b; { return a; }\n", "_Alignas(16) int x; _Thread_local int y; _Noreturn void g(void); int z = _Alignof(int); static inline int h(int (*f)(int), int x) { return (*f)(x); }\n", "void f() { int x = y < z && w > v; if (!(p && *p)) return; *(volatile int *)0x10 = 1; ((void (*)(int))q)(3); MACRO(x); }\n", "struct s { int x; } __attribute__((packed)); void f(void) __attribute__((unused)); typeof(x) y;\n",
],
}
BAD = {
"javascript": ["1 = a;", "const x;", "try {}", "function () {}", "if (a) else b;", "let x x;", "for (;;", "class { }", "x = {a: 1, b};;)", "var 1a = 2;", "import { a from 'b';", "'a"],
"typescript": ["interface A { x: }", "const x: number;", "1 = a;", "function f(a: ) {}", "type A = ;", "enum { A }", "let x: = 1;", "class A { x: ; }", "try {}"],
"java": ["class A { void f() { 1 + 2; } }", "class A { void f() { try {} } }", "class A { void f() { x; } }", "class A { int f() { return } }", "class A { void f() { if (x) } }", "class { }", "class A { void f() { int = 3; } }", "class A { f(int) {} }", "class A { void f() { a b c; } }", "class A { void f() { 1 = a; } }"],
"go": ["package a\nvar x = 1\nimport \"fmt\"\n", "package a\nfunc f() { 1 = a }\n", "package a\nfunc f() { 1 + 2 }\n", "package a\nfunc f() { if x { } \n else { } }\n", "package a\nfunc f(a int b int) {}\n", "package a\nfunc f() { x := }\n", "package a\nfunc f() { for i := 0; i < 3 { } }\n"],
"rust": ["fn f() { 1 + }", "fn f( {}", "struct { x: i32 }", "fn f() { let x 1; }", "enum E { A B }", "fn f() { if { } }", "fn f() { match x { 1 = 2 } }", "impl { }", "fn f() { a b }"],
"c": ["int f(void) { 1 = 2 }", "int f(void) { return 1 + ; }", "struct { int x }", "int x", "int f(void) { if () x; }", "int f(void) { else x; }", "#include <a\nint x;", "int 1x;", "int f(void) { case: x; }"],
}
