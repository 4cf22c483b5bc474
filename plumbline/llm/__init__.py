"""Operations of large-scale training-data pipelines. Nothing else in the package imports this one."""

import os

# The models multiply small matrices; threads would only wait for each other. Without effect if numpy is loaded already.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
