"""rowmark: inspect, filter and label datasets of any size with Spark."""

from rowmark.functions.filters import (
    extended_filter,
    filter_column,
    filter_rows,
    filtered_count,
)
from rowmark.functions.identity import (
    POSITION,
    canonical_json,
    key_fields,
    row_hash,
    row_id,
    row_records,
)
from rowmark.functions.text import cell_preview, cell_text, label_key, slugify
from rowmark.operators.annotate import annotate, annotation_count
from rowmark.operators.labels import (
    LabelSet,
    added_labels,
    label_code_merge,
    label_codes,
    label_set_from_json,
    label_union,
    label_vocab,
    labels_of_task,
    merge_label_sets,
    new_label_set,
    resolve_labels,
    with_labels,
    with_task,
)
from rowmark.operators.merge import (
    conflict_count,
    conflict_groups,
    first_per_id,
    import_new,
    import_report,
    merge,
)
from rowmark.operators.summary import (
    duplicate_ids,
    facet_counts,
    facet_filter,
    record_counts,
    sample_annotations,
    summary,
    time_range,
)
from rowmark.operators.view import (
    hide,
    page,
    page_after,
    page_at,
    ranked_view,
    sample_rows,
    select_visible,
    sort_rows,
)
from rowmark.sources.archives import archive_documents, read_bundle_archives
from rowmark.sources.bundles import (
    annotate_bundle,
    append_annotations,
    append_new,
    bundle_conflicts,
    create_bundle,
    export_snapshot,
    import_bundle,
    known_ids,
    open_bundle,
    read_annotations,
    read_label_set,
    summarize_bundle,
    update_label_set,
    validate_bundle,
    write_label_set,
)
from rowmark.sources.fingerprints import (
    content_sums,
    dataset_fingerprint,
    file_fingerprint,
    growing_fingerprint,
    summed_fingerprint,
)
from rowmark.sources.positions import with_row_index
from rowmark.sources.readers import (
    dataset_meta,
    inspect,
    read_csv,
    read_dataset,
    read_jsonl,
    read_split,
    schema_listing,
)
from rowmark.streaming.feed import annotation_feed, merge_feed, recent_repeats_dropped

__all__ = [name for name in dir() if not name.startswith("_")]
