"""Label algebra: codes roll up the theme tree, rejections flow down, positives win."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.graph import written
from textloom.registry import query


def closure(themes: DataFrame) -> DataFrame:
    """(ancestor, descendant, dist) of every theme with itself and those above it, any status, however deep.

    A path that comes back to a theme ends there, so cycles end too.  The theme
    table is a codebook, hundreds of rows; each step is a join on the parent.
    The result is a written table: plans use it many times, and the recursion
    runs once.
    """
    step = themes.select(F.col("theme_id").alias("ancestor"), F.col("theme_id").alias("descendant"))
    parents = themes.filter(F.col("parent_theme_id").isNotNull()).select(F.col("theme_id").alias("child"), F.col("parent_theme_id").alias("parent"))
    # The way up is a string of ids between separators.
    found = themes.sparkSession.sql(
        """with recursive up(ancestor, descendant, dist, seen) max recursion level 1000000 as (
             select ancestor, descendant, 0, concat(char(31), ancestor, char(31)) from {base}
             union all select p.parent, u.descendant, u.dist + 1, concat(u.seen, p.parent, char(31)) from up u join {parents} p on p.child = u.ancestor where locate(concat(char(31), p.parent, char(31)), u.seen) = 0)
           select ancestor, descendant, min(dist) as dist from up group by ancestor, descendant""",
        base=step,
        parents=parents,
    )
    return written(found)


def active(events: DataFrame) -> DataFrame:
    return events.filter(F.col("deleted_at").isNull())


def positives(codes: DataFrame, tree: DataFrame) -> DataFrame:
    """(theme_id, segment_id): an active code on the theme or below it."""
    c = active(codes).select(F.col("theme_id").alias("descendant"), "segment_id").distinct()
    return c.join(tree, "descendant").select(F.col("ancestor").alias("theme_id"), "segment_id").distinct()


def rejected_below(negatives: DataFrame, tree: DataFrame) -> DataFrame:
    """(theme_id, segment_id): an active negative on the theme or above it."""
    n = active(negatives).select(F.col("theme_id").alias("ancestor"), "segment_id").distinct()
    return n.join(tree, "ancestor").select(F.col("descendant").alias("theme_id"), "segment_id").distinct()


def rejections(negatives: DataFrame, codes: DataFrame, tree: DataFrame) -> DataFrame:
    """(theme_id, segment_id): an active negative on the theme or above it, unless positive."""
    return rejected_below(negatives, tree).join(positives(codes, tree), ["theme_id", "segment_id"], "left_anti")


def reviewed_negatives(codes: DataFrame, negatives: DataFrame, item_reviews: DataFrame, none_confirmations: DataFrame, segments: DataFrame, themes: DataFrame, strict: bool = False, tree: DataFrame | None = None) -> DataFrame:
    """(theme_id, segment_id): judged and not coded.

    Segments of items whose active mark is no older than the theme, confirmed
    "none of these" segments likewise, and rejections, less positives.
    ``strict`` asks that the mark was confirmed or recorded when it was made;
    ``tree`` is the closure of the themes, where the caller has it.
    """
    tree = closure(themes) if tree is None else tree
    marks = item_reviews.filter("unmarked_at is null")
    if strict:
        marks = marks.filter("read_in_full_confirmed_at is not null or recorded_at = marked_at")
    t = themes.select("theme_id", "scheme_id", F.col("created_at").alias("theme_created"))
    judged = segments.select("segment_id", "dataset_id", "item_id").join(marks.select("dataset_id", "item_id", "scheme_id", F.col("marked_at").alias("at")), ["dataset_id", "item_id"]).select("segment_id", "scheme_id", "at")
    none = none_confirmations.filter("unconfirmed_at is null").select("segment_id", "scheme_id", F.col("confirmed_at").alias("at"))
    both = judged.unionByName(none).join(t, "scheme_id").filter("at >= theme_created").select("theme_id", "segment_id").distinct()
    # Positives come off once: rejections join before theirs are taken.
    down = rejected_below(negatives, tree)
    return both.unionByName(down).distinct().join(positives(codes, tree), ["theme_id", "segment_id"], "left_anti")


def training_labels(mode: str, codes, negatives, item_reviews, none_confirmations, segments, themes) -> DataFrame:
    """(theme_id, segment_id, y): ``all_uncoded`` labels every segment, ``reviewed`` and ``read_in_full`` only judged ones."""
    if mode not in ("all_uncoded", "reviewed", "read_in_full"):
        raise ValueError(f"unknown negative mode {mode}")
    tree = closure(themes)
    pos = positives(codes, tree).join(segments.select("segment_id"), "segment_id", "left_semi").select("theme_id", "segment_id", F.lit(1).alias("y"))
    if mode == "all_uncoded":
        grid = segments.select("segment_id").crossJoin(F.broadcast(themes.select("theme_id")))  # the codebook is small
        return grid.join(pos, ["theme_id", "segment_id"], "left").select("theme_id", "segment_id", F.coalesce("y", F.lit(0)).alias("y"))
    neg = reviewed_negatives(codes, negatives, item_reviews, none_confirmations, segments, themes, strict=mode == "read_in_full", tree=tree)
    return pos.unionByName(neg.select("theme_id", "segment_id", F.lit(0).alias("y")))


def mark_status(item_reviews: DataFrame) -> DataFrame:
    """Status of each item's newest active mark, in order of precedence."""
    newest = Window.partitionBy("dataset_id", "item_id", "scheme_id").orderBy(F.desc("marked_at"), F.desc("review_id"))
    m = item_reviews.filter("unmarked_at is null").withColumn("k", F.row_number().over(newest)).filter("k = 1")
    status = (
        F.when(F.col("read_in_full_confirmed_at").isNotNull(), "confirmed").when(F.col("recorded_at").isNull(), "unknown").when(F.col("recorded_at") == F.col("marked_at"), "interactive").otherwise("bulk_unconfirmed")
    )
    return m.select("dataset_id", "item_id", status.alias("status"))


_UP = """up(ancestor, descendant) as (select theme_id, theme_id from themes union select t.parent_theme_id, u.descendant from up u join themes t on t.theme_id = u.ancestor where t.parent_theme_id is not null)"""
_POS = "pos as (select distinct ancestor as theme_id, segment_id from codes join up on descendant = theme_id where deleted_at is null)"
_REJ = "rej as (select distinct descendant as theme_id, segment_id from negatives n join up on ancestor = n.theme_id where deleted_at is null and (descendant, segment_id) not in (select theme_id, segment_id from pos))"
_JUDGED = """{name} as (select distinct t.theme_id, segment_id from segments s join item_reviews r using (dataset_id, item_id) join themes t on t.scheme_id = r.scheme_id where unmarked_at is null and marked_at >= t.created_at {strict}
    union select t.theme_id, segment_id from none_confirmations c join themes t using (scheme_id) where unconfirmed_at is null and confirmed_at >= t.created_at
    union select theme_id, segment_id from rej)"""
_NEG = "neg as (select * from judged except select * from pos)"
_J = _JUDGED.format(name="judged", strict="")
_JS = _JUDGED.format(name="judged", strict="and (read_in_full_confirmed_at is not null or recorded_at = marked_at)")


@query("d1_closure", "themes", oracle=f"with recursive {_UP} select ancestor, descendant from up")
def q_closure(themes):
    return closure(themes).select("ancestor", "descendant")


@query("d2_positives", "codes", "themes", oracle=f"with recursive {_UP}, {_POS} select * from pos")
def q_positives(codes, themes):
    return positives(codes, closure(themes))


@query("d3_rejections", "negatives", "codes", "themes", oracle=f"with recursive {_UP}, {_POS}, {_REJ} select * from rej")
def q_rejections(negatives, codes, themes):
    return rejections(negatives, codes, closure(themes))


@query("d4_reviewed_negatives", "codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", oracle=f"with recursive {_UP}, {_POS}, {_REJ}, {_J}, {_NEG} select * from neg")
def q_reviewed_negatives(*t):
    return reviewed_negatives(*t)


@query("d4_reviewed_negatives_strict", "codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", oracle=f"with recursive {_UP}, {_POS}, {_REJ}, {_JS}, {_NEG} select * from neg")
def q_reviewed_negatives_strict(*t):
    return reviewed_negatives(*t, strict=True)


@query("d5_prediction_flags", "predictions", "codes", "negatives", "themes", oracle=f"""with recursive {_UP}, {_POS}, {_REJ} select model_version, theme_id, segment_id,
    (theme_id, segment_id) in (select theme_id, segment_id from pos) as coded, (theme_id, segment_id) in (select theme_id, segment_id from rej) as rejected from predictions""")
def q_flags(predictions, codes, negatives, themes):
    return with_flags(predictions, codes, negatives, themes).select("model_version", "theme_id", "segment_id", "coded", "rejected")


def with_flags(predictions, codes, negatives, themes) -> DataFrame:
    """Predictions with whether their segment is coded or rejected."""
    tree, key = closure(themes), ["theme_id", "segment_id"]
    d = predictions.join(positives(codes, tree).withColumn("coded", F.lit(True)), key, "left").join(rejections(negatives, codes, tree).withColumn("rejected", F.lit(True)), key, "left")
    return d.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("coded", "rejected")})


for _mode, _neg in (("reviewed", _J), ("read_in_full", _JS)):

    def _labels(*t, mode=_mode):
        return training_labels(mode, *t)

    query(f"d6_training_labels_{_mode}", "codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", oracle=f"with recursive {_UP}, {_POS}, {_REJ}, {_neg}, {_NEG} select theme_id, segment_id, 1 as y from pos where segment_id in (select segment_id from segments) union all select theme_id, segment_id, 0 from neg")(_labels)


@query("d6_training_labels_all", "codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", oracle=f"with recursive {_UP}, {_POS} select t.theme_id, s.segment_id, case when p.segment_id is null then 0 else 1 end as y from segments s cross join themes t left join pos p on p.theme_id = t.theme_id and p.segment_id = s.segment_id")
def q_labels_all(*t):
    return training_labels("all_uncoded", *t)


@query("d7_skip_status", "codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", oracle=f"""with recursive {_UP}, {_POS}, {_REJ}, {_J}, {_NEG}, n as (select theme_id, 1 as y from pos where segment_id in (select segment_id from segments) union all select theme_id, 0 from neg)
    select t.theme_id, count(*) filter (y = 1)::bigint as n_pos, count(*) filter (y = 0)::bigint as n_neg, case when count(*) filter (y = 1) < 25 then 'skipped_insufficient_positives' when count(*) filter (y = 0) < 50 then 'skipped_insufficient_negatives' else 'trained' end as status from themes t left join n using (theme_id) group by 1""")
def skip_status(*t, least_pos: int = 25, least_neg: int = 50):
    y = training_labels("reviewed", *t)
    n = y.groupBy("theme_id").agg(F.count_if(F.col("y") == 1).alias("n_pos"), F.count_if(F.col("y") == 0).alias("n_neg"))
    n = t[-1].select("theme_id").join(n, "theme_id", "left").na.fill(0)
    return n.withColumn("status", F.when(F.col("n_pos") < least_pos, "skipped_insufficient_positives").when(F.col("n_neg") < least_neg, "skipped_insufficient_negatives").otherwise("trained"))


@query("d8_label_state", "codes", "negatives", oracle="""with e as (select segment_id, theme_id, coder, created_at as tm, 2 * code_id as seq, 'code' as kind from codes union all select segment_id, theme_id, coder, deleted_at, 2 * code_id + 1, 'uncode' from codes where deleted_at is not null
      union all select segment_id, theme_id, coder, created_at, 2 * negative_id, 'reject' from negatives union all select segment_id, theme_id, coder, deleted_at, 2 * negative_id + 1, 'unreject' from negatives where deleted_at is not null)
    select segment_id, theme_id, coder, arg_max(kind, tm || '/' || lpad(seq::varchar, 20, '0')) as state, count(*)::bigint as n from e group by all""")
def label_state(codes, negatives):
    """Event-sourced labels: of each (segment, theme, coder) the last event decides; code and rejection exclude each other."""
    key = ["segment_id", "theme_id", "coder"]
    ev = lambda d, i, at, odd, kind: d.filter(F.col(at).isNotNull()).select(*key, F.col(at).alias("at"), (2 * F.col(i) + odd).alias("seq"), F.lit(kind).alias("kind"))
    e = ev(codes, "code_id", "created_at", 0, "code").unionByName(ev(codes, "code_id", "deleted_at", 1, "uncode"))
    e = e.unionByName(ev(negatives, "negative_id", "created_at", 0, "reject")).unionByName(ev(negatives, "negative_id", "deleted_at", 1, "unreject"))
    return e.groupBy(*key).agg(F.max_by("kind", F.struct("at", "seq")).alias("state"), F.count("*").alias("n"))


def merge_themes(codes, negatives, themes, source: str, target: str, now: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after ``source`` was merged into ``target``.

    Codes are re-pointed in place; of one segment and coder the target's own
    code stays and the other is deleted.  Where a coder then has the target
    coded, rejections of it are deleted; other rejections move like codes, and
    one that the target had deleted comes back with the moved one's provenance.
    The source is archived and names the target.
    """
    who = ["segment_id", "coder"]
    gone = F.lit(now)
    theme = F.col("theme_id")
    coded = active(codes).filter(theme == target).select(*who, F.lit(True).alias("has")).distinct()
    c = codes.join(coded, who, "left")
    moving = (theme == source) & F.col("deleted_at").isNull()
    # Two active source codes of one coder can't both move: the older one does.
    first = active(codes).filter(theme == source).groupBy(*who).agg(F.min("code_id").alias("first"))
    c = c.join(first, who, "left")
    stays = moving & (F.col("has").isNotNull() | (F.col("code_id") != F.col("first")))
    new_codes = c.withColumn("theme_id", F.when(moving & ~stays, target).otherwise(theme)).withColumn("deleted_at", F.when(stays, gone).otherwise(F.col("deleted_at"))).select(*codes.columns)
    coded_now = active(new_codes).filter(theme == target).select(*who, F.lit(True).alias("coded")).distinct()
    own = negatives.filter(theme == target).select(*who, F.col("negative_id").alias("own_id"), F.col("deleted_at").alias("own_deleted"))
    incoming = active(negatives).filter(theme == source).select(*who, F.col("negative_id").alias("new_id"), F.col("created_at").alias("new_created"))
    n = negatives.join(coded_now, who, "left").join(own, who, "left").join(incoming, who, "left")
    moving = (theme == source) & F.col("deleted_at").isNull()
    back = (theme == target) & F.col("deleted_at").isNotNull() & F.col("new_id").isNotNull() & F.col("coded").isNull()
    drops = moving & (F.col("coded").isNotNull() | F.col("own_id").isNotNull())
    cancelled = (theme == target) & F.col("deleted_at").isNull() & F.col("coded").isNotNull()
    new_negatives = n.withColumns(
        {
            "created_at": F.when(back, F.col("new_created")).otherwise(F.col("created_at")),
            "deleted_at": F.when(drops | cancelled, gone).when(back, F.lit(None)).otherwise(F.col("deleted_at")),
            "theme_id": F.when(moving & ~drops, target).otherwise(theme),
        }
    ).select(*negatives.columns)
    is_source = theme == source
    new_themes = themes.withColumn("merged_into", F.when(is_source, target).otherwise(F.col("merged_into") if "merged_into" in themes.columns else F.lit(None))).withColumn("status", F.when(is_source, "archived").otherwise(F.col("status")))
    return new_codes, new_negatives, new_themes


_MERGE = """tc as (select distinct segment_id, coder from codes where theme_id = 's__toxic' and deleted_at is null), sc as (select segment_id, coder, min(code_id) as first from codes where theme_id = 's__mild' and deleted_at is null group by 1, 2),
    nc as (select c.*, case when theme_id = 's__mild' and deleted_at is null then case when (segment_id, coder) in (select segment_id, coder from tc) or code_id not in (select first from sc) then 'drop' else 'move' end else 'keep' end as act from codes c),
    now_coded as (select segment_id, coder from nc where act = 'move' or (theme_id = 's__toxic' and deleted_at is null))"""


@query("d11_merge_themes", "codes", "negatives", "themes", oracle=f"with {_MERGE} select code_id, segment_id, case act when 'move' then 's__toxic' else theme_id end as theme_id, coder, case act when 'drop' then '2024-04-01' else deleted_at end as deleted_at from nc")
def q_merge_codes(codes, negatives, themes):
    return merge_themes(codes, negatives, themes, "s__mild", "s__toxic", "2024-04-01")[0].select("code_id", "segment_id", "theme_id", "coder", "deleted_at")


_BOTH_NEGATIVES = "both_n as (select negative_id, segment_id, theme_id, coder, created_at, deleted_at from negatives union all select negative_id + 1000000000, segment_id, 's__mild', case when doc_id % 3 = 0 then 'coder0' else coder end, '2024-02-09', null from negatives where theme_id = 's__toxic' and doc_id % 4 <> 1)"


@query("d11_merge_negatives", "codes", "own_negatives", "themes", oracle=f"""with {_MERGE}, {_BOTH_NEGATIVES}, tn as (select segment_id, coder, negative_id as own_id, deleted_at as own_deleted from both_n where theme_id = 's__toxic'), sn as (select segment_id, coder, created_at as new_created from both_n where theme_id = 's__mild' and deleted_at is null)
    select negative_id, case when n.theme_id = 's__mild' and deleted_at is null and own_id is null and not coded then 's__toxic' else n.theme_id end as theme_id,
      case when n.theme_id = 's__toxic' and deleted_at is not null and new_created is not null and not coded then new_created else created_at end as created_at,
      case when n.theme_id = 's__mild' and deleted_at is null and (coded or own_id is not null) then '2024-04-01' when n.theme_id = 's__toxic' and deleted_at is null and coded then '2024-04-01' when n.theme_id = 's__toxic' and deleted_at is not null and new_created is not null and not coded then null else deleted_at end as deleted_at
    from (select b.*, (segment_id, coder) in (select segment_id, coder from now_coded) as coded from both_n b) n left join tn using (segment_id, coder) left join sn using (segment_id, coder)""")
def q_merge_negatives(codes, negatives, themes):
    """Rejections after the merge; the source has some on segments that the target has too, by the same and by other coders."""
    return merge_themes(codes, negatives, themes, "s__mild", "s__toxic", "2024-04-01")[1].select("negative_id", "theme_id", "created_at", "deleted_at")


@query("d11_merged_theme", "codes", "negatives", "themes", oracle="select theme_id, case theme_id when 's__mild' then 'archived' else status end as status, case theme_id when 's__mild' then 's__toxic' end as merged_into from themes")
def q_merge_theme(codes, negatives, themes):
    return merge_themes(codes, negatives, themes, "s__mild", "s__toxic", "2024-04-01")[2].select("theme_id", "status", "merged_into")


@query("d16_mark_status", "item_reviews", oracle="""select dataset_id, item_id, case when read_in_full_confirmed_at is not null then 'confirmed' when recorded_at is null then 'unknown' when recorded_at = marked_at then 'interactive' else 'bulk_unconfirmed' end as status
    from item_reviews where unmarked_at is null qualify row_number() over (partition by dataset_id, item_id, scheme_id order by marked_at desc, review_id desc) = 1""")
def q_mark_status(item_reviews):
    return mark_status(item_reviews)


_CODED = "coded as (select dataset_id, item_id, count(distinct segment_id) as n, max(c.created_at) as last_coded from codes c join segments s using (segment_id) where deleted_at is null group by 1, 2)"


@query("d17_unconfirmed_marks", "item_reviews", "codes", "segments", oracle=f"""with {_CODED} select r.item_id, coalesce(n, 0)::bigint as n_coded, coalesce(n, 0) >= 5 as inferred from item_reviews r left join coded using (dataset_id, item_id)
    where unmarked_at is null and not (read_in_full_confirmed_at is not null or coalesce(recorded_at = marked_at, false))""")
def unconfirmed_marks(item_reviews, codes, segments):
    m = mark_status(item_reviews).filter("status in ('unknown', 'bulk_unconfirmed')").join(coded_items(codes, segments), ["dataset_id", "item_id"], "left")
    n = F.coalesce("n_coded", F.lit(0)).cast("long")
    return m.select("item_id", n.alias("n_coded"), (n >= 5).alias("inferred"))


def coded_items(codes, segments) -> DataFrame:
    """Per item: distinct segments with an active code, and the last code's time."""
    j = active(codes).join(segments.select("segment_id", "dataset_id", "item_id"), "segment_id")
    return j.groupBy("dataset_id", "item_id").agg(F.countDistinct("segment_id").alias("n_coded"), F.max("created_at").alias("last_coded"))


@query("a13_coded_segment_counts", "codes", "segments", oracle=f"with {_CODED} select item_id, n::bigint as n_coded, last_coded from coded")
def q_coded_items(codes, segments):
    return coded_items(codes, segments).select("item_id", "n_coded", "last_coded")


@query("a14_backfill_candidates", "codes", "segments", "item_reviews", oracle=f"with {_CODED} select item_id, n::bigint as n_coded, last_coded from coded anti join (select * from item_reviews where unmarked_at is null) using (dataset_id, item_id)")
def backfill(codes, segments, item_reviews):
    marked = item_reviews.filter("unmarked_at is null").select("dataset_id", "item_id")
    return coded_items(codes, segments).join(marked, ["dataset_id", "item_id"], "left_anti").select("item_id", "n_coded", "last_coded")


@query("a9_progress_by_theme", "codes", "segments", "themes", oracle=f"with recursive {_UP}, {_POS} select t.theme_id, count(distinct s.segment_id)::bigint as n from themes t left join pos p using (theme_id) left join segments s on s.segment_id = p.segment_id where status = 'active' group by 1")
def progress_by_theme(codes, segments, themes):
    p = positives(codes, closure(themes)).join(segments.select("segment_id"), "segment_id", "left_semi").groupBy("theme_id").agg(F.count("*").alias("n"))
    return themes.filter("status = 'active'").select("theme_id").join(p, "theme_id", "left").na.fill(0)


@query("a9_progress_by_group", "codes", "segments", oracle="select group_name, count(*)::bigint as total, count(*) filter (segment_id in (select segment_id from codes where deleted_at is null))::bigint as coded from segments group by 1")
def progress_by_group(codes, segments):
    c = active(codes).select("segment_id").distinct().withColumn("is_coded", F.lit(True))
    return segments.select("segment_id", "group_name").join(c, "segment_id", "left").groupBy("group_name").agg(F.count("*").alias("total"), F.count_if("is_coded").alias("coded"))


@query("a9_progress_totals", "codes", "segments", "themes", oracle="""select count(*)::bigint as segments, count(distinct (dataset_id, item_id))::bigint as items, count(*) filter (segment_id in (select segment_id from codes join themes using (theme_id) where deleted_at is null and scheme_id = 's'))::bigint as coded from segments""")
def progress_totals(codes, segments, themes, scheme: str = "s"):
    own = F.broadcast(themes.filter(F.col("scheme_id") == scheme).select("theme_id"))
    c = active(codes).join(own, "theme_id", "left_semi").select("segment_id").distinct().withColumn("is_coded", F.lit(True))
    return segments.select("segment_id", "dataset_id", "item_id").join(c, "segment_id", "left").agg(F.count("*").alias("segments"), F.countDistinct("dataset_id", "item_id").alias("items"), F.count_if("is_coded").alias("coded"))


@query("a10_roll_up_counts", "codes", "themes", oracle=f"with recursive {_UP}, {_POS} select theme_id, count(*)::bigint as n from pos group by 1")
def roll_up_counts(codes, themes):
    return positives(codes, closure(themes)).groupBy("theme_id").agg(F.count("*").alias("n"))


_SIX = ("codes", "negatives", "segments", "themes", "item_reviews")
_COUNTS = f"""{_UP}, {_POS}, ri as (select dataset_id, item_id from item_reviews where scheme_id = 's' and unmarked_at is null qualify row_number() over (partition by dataset_id, item_id order by marked_at desc, review_id desc) = 1 and (read_in_full_confirmed_at is not null or coalesce(recorded_at = marked_at, false))),
    cn as (select t.theme_id, coalesce(p, 0)::bigint as positives, coalesce(e, 0)::bigint as exemplars, coalesce(g, 0)::bigint as exemplar_groups, coalesce(m, 0)::bigint as near_misses, coalesce(r, 0)::bigint as gold_items from themes t
      left join (select theme_id, count(*) as p from pos group by 1) using (theme_id)
      left join (select theme_id, count(*) as e, count(distinct group_name) as g from codes join segments using (segment_id) where deleted_at is null and is_exemplar group by 1) using (theme_id)
      left join (select theme_id, count(*) as m from negatives where deleted_at is null and is_near_miss group by 1) using (theme_id)
      left join (select theme_id, count(distinct (dataset_id, item_id)) as r from pos join segments using (segment_id) join ri using (dataset_id, item_id) group by 1) using (theme_id))"""


@query("a11_theme_counts", *_SIX, oracle=f"with recursive {_COUNTS} select * from cn")
def theme_counts(codes, negatives, segments, themes, item_reviews):
    """Of each theme: positives, exemplars and their groups, near misses, and read-in-full items with a positive."""
    pos = positives(codes, closure(themes))
    read = mark_status(item_reviews).filter("status in ('confirmed', 'interactive')").select("dataset_id", "item_id")
    p = pos.groupBy("theme_id").agg(F.count("*").alias("positives"))
    e = active(codes).filter("is_exemplar").join(segments.select("segment_id", "group_name"), "segment_id").groupBy("theme_id").agg(F.count("*").alias("exemplars"), F.countDistinct("group_name").alias("exemplar_groups"))
    m = active(negatives).filter("is_near_miss").groupBy("theme_id").agg(F.count("*").alias("near_misses"))
    g = pos.join(segments.select("segment_id", "dataset_id", "item_id"), "segment_id").join(read, ["dataset_id", "item_id"], "left_semi").groupBy("theme_id").agg(F.countDistinct("dataset_id", "item_id").alias("gold_items"))
    out = themes.select("theme_id")
    for d in (p, e, m, g):
        out = out.join(d, "theme_id", "left")
    return out.na.fill(0)


#: What a complete theme has at least.
DEFINITION_WORDS, EXEMPLARS, EXEMPLAR_GROUPS, NEAR_MISSES = 15, 3, 2, 2


@query("a12_theme_completeness", *_SIX, oracle=rf"""with recursive {_COUNTS}, ch as (select theme_id, len(regexp_extract_all(coalesce(description, ''), '\S+')) >= 15 as definition, coalesce(trim(inclusion_criteria), '') <> '' and coalesce(trim(exclusion_criteria), '') <> '' as criteria, exemplars >= 3 and exemplar_groups >= 2 as exemplars, near_misses >= 2 as near_misses, gold_items >= 1 as gold
      from themes join cn using (theme_id))
    select *, (definition::int + criteria::int + exemplars::int + near_misses::int + gold::int)::bigint as score from ch""")
def theme_completeness(codes, negatives, segments, themes, item_reviews):
    """Five checks a theme (definition, both criteria, exemplars of several groups, near misses, a positive in a read-in-full item) and how many pass."""
    from textloom.functions.text import strip, word_count

    filled = lambda c: F.coalesce(strip(c), F.lit("")) != ""
    d = themes.join(theme_counts(codes, negatives, segments, themes, item_reviews), "theme_id")
    checks = {
        "definition": word_count("description") >= DEFINITION_WORDS,
        "criteria": filled("inclusion_criteria") & filled("exclusion_criteria"),
        "exemplars": (F.col("exemplars") >= EXEMPLARS) & (F.col("exemplar_groups") >= EXEMPLAR_GROUPS),
        "near_misses": F.col("near_misses") >= NEAR_MISSES,
        "gold": F.col("gold_items") >= 1,
    }
    score = sum((c.cast("long") for c in checks.values()), F.lit(0))
    return d.select("theme_id", *(c.alias(k) for k, c in checks.items()), score.alias("score"))


@query("d20_label_sources", "codes", "negatives", "item_reviews", "none_confirmations", "segments", "themes", oracle=f"""with recursive {_UP}, {_POS}, {_REJ}, {_JS}, {_NEG}
    select theme_id, segment_id, 'pos' as label, case when (theme_id, segment_id) in (select theme_id, segment_id from codes where deleted_at is null) then 'code' else 'code_rollup' end as source from pos
    union all select n.theme_id, n.segment_id, 'neg', case when (n.theme_id, n.segment_id) in (select theme_id, segment_id from rej) then 'explicit_rejection'
      when (n.theme_id, n.segment_id) in (select t.theme_id, segment_id from none_confirmations join themes t using (scheme_id) where unconfirmed_at is null and confirmed_at >= t.created_at) then 'none_confirmed' else 'read_in_full_uncoded' end from neg n""")
def label_sources(codes, negatives, item_reviews, none_confirmations, segments, themes):
    """Where each label comes from; of several reasons the strongest.  Only marks known to be read in full make negatives."""
    tree, key = closure(themes), ["theme_id", "segment_id"]
    direct = active(codes).select(*key).distinct().withColumn("direct", F.lit(True))
    pos = positives(codes, tree).join(direct, key, "left").select(*key, F.lit("pos").alias("label"), F.when(F.col("direct"), "code").otherwise("code_rollup").alias("source"))
    rej = rejections(negatives, codes, tree).withColumn("rejected", F.lit(True))
    none = none_confirmations.filter("unconfirmed_at is null").join(themes.select("theme_id", "scheme_id", "created_at"), "scheme_id").filter("confirmed_at >= created_at").select(*key).distinct().withColumn("none", F.lit(True))
    neg = reviewed_negatives(codes, negatives, item_reviews, none_confirmations, segments, themes, strict=True, tree=tree).join(rej, key, "left").join(none, key, "left")
    source = F.when(F.col("rejected"), "explicit_rejection").when(F.col("none"), "none_confirmed").otherwise("read_in_full_uncoded")
    return pos.unionByName(neg.select(*key, F.lit("neg").alias("label"), source.alias("source")))


@query("p13_theme_listing", "themes", "codes", oracle="select theme_id, name, depth, coalesce(n, 0)::bigint as code_count from themes left join (select theme_id, count(*) as n from codes where deleted_at is null group by 1) using (theme_id) where status = 'active'")
def theme_listing(themes, codes):
    n = active(codes).groupBy("theme_id").agg(F.count("*").alias("code_count"))
    return themes.filter("status = 'active'").select("theme_id", "name", "depth").join(n, "theme_id", "left").na.fill(0).orderBy("depth", "name")


@query("p14_scheme_listing", "themes", "codes", oracle="select scheme_id, count(*) filter (status = 'active')::bigint as theme_count, sum(coalesce(n, 0))::bigint as code_count from themes left join (select theme_id, count(*) as n from codes where deleted_at is null group by 1) using (theme_id) group by 1")
def scheme_listing(themes, codes):
    n = active(codes).groupBy("theme_id").agg(F.count("*").alias("n"))
    return themes.join(n, "theme_id", "left").groupBy("scheme_id").agg(F.count_if(F.col("status") == "active").alias("theme_count"), F.sum(F.coalesce("n", F.lit(0))).cast("long").alias("code_count"))
