"""Print the formatted physical plans of the flagship stages: python scripts/explain_flagship.py [sf_dir]

Shows where the filters reach the scan, the partial aggregate before the dedup shuffle, the
window-group limit before the cap shuffle, and which joins are broadcast.
"""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from vitrine import config as C  # noqa: E402
from vitrine.plans import preprocess as P  # noqa: E402
from vitrine.session import get_session  # noqa: E402
from vitrine.sources.adapters import raw_products  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session()
    raw = raw_products(spark, sf)
    stages = {
        "filter + keep-first dedup": P.dedup_products(P.filter_valid_price(raw)),
        "score (rank over distinct review counts)": P.score(P.median_fill_days(P.scored_layer(spark, sf))),
        "per-store cap + label": P.topk_label(P.cap_per_source(P.scored_layer(spark, sf),
                                                               P.store_caps(spark, C.DEFAULT_PROFILE),
                                                               C.DEFAULT_PROFILE.max_cap)),
    }
    for name, df in stages.items():
        print(f"===== {name} =====")
        df.explain("formatted")


if __name__ == "__main__":
    main()
