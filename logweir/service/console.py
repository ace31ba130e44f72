"""The console: one page that sends queries and jobs, drains result pages and keeps a history."""

CONSOLE = """<!doctype html>
<meta charset="utf-8"><title>logweir</title>
<style>body{font:14px sans-serif;margin:2em}textarea{width:100%}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left}</style>
<textarea id="sql" rows="4">SELECT * FROM logs ORDER BY timestamp</textarea>
<p>from <input id="from" value="0"> to <input id="to" value="9223372036854775807"> limit <input id="limit" value="1000">
<button onclick="ask()">Query</button> <button onclick="job()">Job</button>
<select id="past" onchange="sql.value = this.value"></select> <span id="note"></span></p>
<table id="rows"></table>
<script>
const el = id => document.getElementById(id), sql = el("sql"), HISTORY = 50;
// Bounds are 64-bit integers, so they are put into the text of the body and never through a number.
const body = () => `{"sql": ${JSON.stringify(sql.value)}, "time_from": ${el("from").value}, "time_to": ${el("to").value}, "limit": ${el("limit").value}}`;
const past = () => JSON.parse(localStorage.getItem("past") || "[]");
function remember() {
  localStorage.setItem("past", JSON.stringify([sql.value, ...past().filter(x => x !== sql.value)].slice(0, HISTORY)));
  listed();
}
function listed() { el("past").replaceChildren(...past().map(x => new Option(x, x))); }
function show(rows, note) {
  const names = [...new Set(rows.flatMap(Object.keys))];
  const line = (kind, values) => { const tr = document.createElement("tr"); values.forEach(v => { const c = document.createElement(kind); c.textContent = v ?? ""; tr.append(c); }); return tr; };
  el("rows").replaceChildren(line("th", names), ...rows.map(r => line("td", names.map(n => typeof r[n] === "object" ? JSON.stringify(r[n]) : r[n]))));
  el("note").textContent = note;
}
async function send(path) {
  remember();
  const got = await fetch(path, {method: "POST", body: body()}), text = await got.text();
  if (!got.ok) { show([], text); throw new Error(text); }
  return text;
}
async function ask() {
  const rows = (await send("/query")).trim().split("\\n").map(x => JSON.parse(x)), stats = rows.pop();
  show(rows, JSON.stringify(stats));
}
async function job() {
  const id = JSON.parse(await send("/jobs")).job_id;
  let state = "queued";
  while (state === "queued" || state === "running") {
    await new Promise(r => setTimeout(r, 500));
    state = (await (await fetch("/jobs/" + id)).json()).state;
    el("note").textContent = state;
  }
  const rows = [];
  for (let page = 0, total = 1; state === "complete" && rows.length < total; page++) {
    const got = await (await fetch(`/jobs/${id}/results?page=${page}&page_size=100`)).json();
    if (!got.rows.length) break;
    rows.push(...got.rows);
    total = got.total;
  }
  show(rows, state);
}
listed();
</script>
"""
