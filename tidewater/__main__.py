from tidewater.cli import main

raise SystemExit(main())
