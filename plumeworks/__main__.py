"""``python -m plumeworks FOLDER --pipeline NAME``."""

from .plans.pipelines import main

if __name__ == "__main__":
    main()
