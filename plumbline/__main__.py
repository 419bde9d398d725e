from plumbline.plans.cli import main

raise SystemExit(main())
