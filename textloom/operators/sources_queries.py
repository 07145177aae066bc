"""Queries of the parsers, over transcripts made from the driver's conversations."""

from pyspark.sql import functions as F

from textloom.functions.text import WS
from textloom.operators.corpus import _strip, _words
from textloom.registry import query
from textloom.sources import transcripts as S


def _lines(turns, stamped):
    """Transcript lines: each turn's header, then its text; labelled ones have an incidental label now and then."""
    head = F.concat(F.lit("0:"), F.lpad((F.col("turn_index") % 60).cast("string"), 2, "0"), F.lit(":00 "), "speaker_name") if stamped else F.concat(F.lit("Note"), "turn_index", F.lit(": aside"))
    body = F.col("content") if stamped else F.concat("speaker_name", F.lit(": "), "content")
    text = F.concat(head, F.lit("\n"), body)
    d = turns.select("item_id", "turn_index", F.posexplode(F.split(text, "\n")).alias("k", "line"))
    return d.select("item_id", (F.col("turn_index") * 100000 + F.col("k")).alias("line_no"), "line")


_SAID = rf"""array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: {_strip("x")}), lambda x: x <> ''), ' ')"""


@query("s9_stamped_turns", "turns", oracle=rf"""select item_id, (row_number() over (partition by item_id order by turn_index) - 1)::bigint as turn_index, speaker_name, '0:' || lpad((turn_index % 60)::varchar, 2, '0') || ':00' as timestamp, {_SAID} as content from turns""")
def stamped(turns):
    return S.stamped_turns(_lines(turns, True))


_LABELLED = rf"""raw as (select item_id, turn_index * 100000 as line_no, 'Note' || turn_index::varchar || ': aside' as line from turns union all
      select item_id, turn_index * 100000 + k, x from (select item_id, turn_index, unnest(string_split(speaker_name || ': ' || content, chr(10))) as x, generate_subscripts(string_split(speaker_name || ': ' || content, chr(10)), 1) as k from turns)),
    st as (select item_id, line_no, {_strip("line")} as line from raw where {_strip("line")} <> ''),
    ma as (select *, regexp_extract(line, '^\*{{0,2}}([A-Za-z][\p{{L}}\p{{N}}_ .''\-]{{0,39}}?)\*{{0,2}}[{WS}]*:\*{{0,2}}[{WS}]*(.*)$', ['a', 'b']) as m from st),
    la as (select item_id, line_no, case when {_strip("m.a")} <> '' and {_words("m.a")} <= 5 then {_strip("m.a")} end as label, case when {_strip("m.a")} <> '' and {_words("m.a")} <= 5 then {_strip("m.b")} else line end as said from ma),
    kn as (select item_id, label from la where label is not null group by 1, 2 having count(*) >= 2),
    ok as (select item_id, label from kn where item_id in (select item_id from kn group by 1 having count(*) >= 2)),
    nu as (select la.*, sum(case when ok.label is not null then 1 else 0 end) over (partition by la.item_id order by line_no) as turn from la left join ok on ok.item_id = la.item_id and ok.label = la.label where la.item_id in (select item_id from ok)),
    tu as (select item_id, turn, arg_min(label, line_no) as speaker_name, string_agg(said, ' ' order by line_no) filter (said <> '') as content from nu where turn > 0 group by 1, 2)"""


@query("s10_labelled_turns", "turns", oracle=f"with {_LABELLED} select item_id, (turn - 1)::bigint as turn_index, speaker_name, content from tu where content <> ''")
def labelled(turns):
    return S.labelled_turns(_lines(turns, False)).drop("timestamp")


@query("s11_transcript_formats", "turns", oracle=rf"""with lab as (select * from turns where item_id::bigint % 3 = 1), ma as (select item_id, speaker_name, count(*) as n from lab group by 1, 2 having count(*) >= 2),
    fit as (select item_id from ma group by 1 having count(*) >= 2)
    select item_id, case when item_id::bigint % 3 = 0 then 'timestamped' else 'labeled' end as format from turns where item_id::bigint % 3 = 0 or item_id in (select item_id from fit) group by all""")
def formats(turns):
    """Of items in three kinds of transcript (timestamped, labelled, plain prose) the format that each is read as."""
    kind = lambda k: F.pmod(F.col("item_id").cast("long"), F.lit(3)) == k
    plain = turns.filter(kind(2)).select("item_id", F.col("turn_index").alias("line_no"), F.lit("prose without any label").alias("line"))
    lines = _lines(turns.filter(kind(0)), True).unionByName(_lines(turns.filter(kind(1)), False).filter("line not like 'Note%'")).unionByName(plain)
    return S.transcript_turns(lines).select("item_id", "format").distinct()


#: The back-channel rules as a walk over an item's long blocks, one after another.
_BRIDGED = rf"""src as (select item_id, turn_index, case when turn_index % 7 = 3 then null else speaker_name end as speaker, case when turn_index % 3 = 1 then array_to_string(string_split(content, ' ')[1:3], ' ') when turn_index % 11 = 5 then 'why so?' when turn_index % 13 = 6 then '  ' else content end as content from turns),
    s0 as (select item_id, turn_index as i, speaker, {_strip("content")} as content from src where {_strip("content")} <> ''),
    s1 as (select *, case when row_number() over w = 1 or speaker is distinct from lag(speaker) over w then 1 else 0 end as fresh from s0 window w as (partition by item_id order by i)),
    s2 as (select *, sum(fresh) over (partition by item_id order by i) as run from s1),
    bl as (select item_id, min(i) as i, max(speaker) as speaker, string_agg(content, ' ' order by i) as content from s2 group by item_id, run),
    bs as (select *, {_words("content")} <= 8 and not ends_with(content, '?') as short from bl),
    sg as (select *, sum(case when short then 0 else 1 end) over (partition by item_id order by i) as g from bs),
    gr as (select item_id, g, max({{'i': i, 's': speaker}}) filter (not short) as own, max({{'i': i, 's': speaker}}) filter (short) as last from sg group by 1, 2),
    wk as (select item_id, g, false as taken, cast(null as bigint) as target from gr where g = 1 union all
      select item_id, g, coalesce(more and prev.s is not distinct from s, false), case when more and prev.s is not distinct from s then prev.i end from (select w.item_id, n.g, n.own.s as s, c.last is not null as more, case when w.taken then p.last else c.own end as prev
        from wk w join gr c on c.item_id = w.item_id and c.g = w.g join gr n on n.item_id = w.item_id and n.g = w.g + 1 left join gr p on p.item_id = w.item_id and p.g = w.g - 1)),
    tk as (select item_id, own.i as i, target from wk join gr using (item_id, g) where taken),
    ct as (select b.item_id, b.i, b.speaker, b.content || coalesce(' ' || x.content, '') as content from bs b left join (select tk.item_id, target, content from tk join bl using (item_id, i)) x on x.item_id = b.item_id and x.target = b.i anti join tk on tk.item_id = b.item_id and tk.i = b.i),
    r1 as (select *, case when row_number() over w = 1 or speaker is distinct from lag(speaker) over w then 1 else 0 end as fresh from ct window w as (partition by item_id order by i)),
    r2 as (select *, sum(fresh) over (partition by item_id order by i) as run from r1)
    select item_id, run::bigint - 1 as turn_index, max(speaker) as speaker_name, string_agg(content, ' ' order by i) as content from r2 group by item_id, run"""


@query("s12_bridged_turns", "turns", oracle=f"with recursive {_BRIDGED}")
def bridged(turns):
    """Conversations with short asides, questions, blanks and unnamed speakers put in."""
    t, k = F.col("turn_index"), F.col("content")
    few = F.array_join(F.slice(F.split(k, " "), 1, 3), " ")
    content = F.when(t % 3 == 1, few).when(t % 11 == 5, "why so?").when(t % 13 == 6, "  ").otherwise(k)
    return S.bridge_backchannels(turns.select("item_id", "turn_index", F.when(t % 7 != 3, F.col("speaker_name")).alias("speaker_name"), content.alias("content")))
