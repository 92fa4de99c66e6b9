"""spark-submit entry point for the command line (python -m brickyard works locally).

    zip -r brickyard.zip brickyard
    spark-submit --py-files brickyard.zip \
        --conf spark.checkpoint.dir=hdfs:///shared/brickyard-ckpt \
        brickyard_cli.py run --transactions ... --affordability ... --supply ... --out ...
"""

import sys

from brickyard.__main__ import main

if __name__ == "__main__":
    sys.exit(main())
