"""Names and patterns that detections look for.

COMPLETE tells which lists are known to be whole; the others are the publicly visible part.
"""

# ---- Fixed values ----
BYOVD_DRIVERS = ("zamguard64", "ZAM", "ZemanaAntiMalware", "RTCore64")
HVCI_KEYS = ("\\Control\\CI\\Config", "\\Control\\DeviceGuard")
HVCI_VALUES = ("VulnerableDriverBlocklistEnable", "EnableVirtualizationBasedSecurity", "HypervisorEnforcedCodeIntegrity")
QWCRYPT_FILES = ("rbcw.exe", "ADNotificationManager.exe")
QWCRYPT_SCRIPTS = ("Get-VM", "Stop-VM", "vssadmin delete shadows", "wbadmin delete")
WEBDAV_LOLBINS = ("rundll32.exe", "msiexec.exe", "regsvr32.exe", "mshta.exe", "wscript.exe", "certutil.exe")
WEBDAV_INDICATORS = ("DavWWWRoot", "@SSL\\", "@80\\", "@443\\")
RANSOM_NOTES = ("_readme.txt", "LockBit_README.txt", "HOW_TO_DECRYPT.txt", "@Please_Read_Me@.txt", "akira_readme.txt", "FILES_ENCRYPTED.txt")
ADEXPLORER_KEYS = ("\\Software\\Sysinternals\\Active Directory Explorer",)
ZEMANA_THUMBPRINT = "96A7749D856CB49DE32005BCDD8621F38E2B4C05"
SIDELOAD_DLLS = ("srvcli.dll", "netutils.dll")
SIDELOAD_SAFE = ("c:\\windows\\system32\\", "c:\\windows\\syswow64\\")
CHISEL_INDICATORS = ("--reverse", "R:socks", "socks5", "--tls-skip-verify")
RPIVOT_INDICATORS = ("cl.py", "client.py", "--headless")
IMPACKET_REDIRECTS = ("\\\\127.0.0.1\\ADMIN$\\__",)
ARCHIVERS = ("7z.exe", "7za.exe")
STAGING_PARENTS = ("pcalua.exe", "wmiprvse.exe")
BROWSER_TASKS = ("GoogleUpdateTask", "MicrosoftEdgeUpdate", "MozillaMaintenance", "BraveSoftwareUpdate")
WORKER_SUFFIX = ".workers.dev"
BROWSERS = ("chrome.exe", "msedge.exe", "firefox.exe", "brave.exe")
# Processes and services that ransomware is known to stop, and parts of such names.
KILLED_PARTS = ("sqlservr", "veeam", "msmpeng", "sophos", "mbam")
STOPPED_PARTS = ("veeambackupsvc", "gxvss", "sqlserveragent", "mssqlserver")
KILLED_PROCESSES = (
    "sql.exe", "sqlserv.exe", "sqlbrowser.exe", "sqlwriter.exe", "sqlagent.exe", "sqlservr.exe", "oracle.exe", "ocssd.exe", "dbsnmp.exe", "synctime.exe", "agntsvc.exe",
    "isqlplussvc.exe", "xfssvccon.exe", "mydesktopservice.exe", "mydesktopqos.exe", "ocautoupds.exe", "encsvc.exe", "firefox.exe", "tbirdconfig.exe", "ocomm.exe",
    "dbeng50.exe", "sqbcoreservice.exe", "excel.exe", "infopath.exe", "msaccess.exe", "mspub.exe", "onenote.exe", "outlook.exe", "powerpnt.exe", "steam.exe", "thebat.exe",
    "thunderbird.exe", "visio.exe", "winword.exe", "wordpad.exe", "notepad.exe", "veeam.exe", "veeamguestindexer.exe", "veeamtransportsvc.exe", "veeamdeploymentsvc.exe",
    "veeammountservice.exe", "sophos.exe", "SAVAdminService.exe", "SAVService.exe", "SEDservice.exe", "HitmanPro.Alert.exe", "GoogleUpdate.exe", "mbamtray.exe", "mbam.exe",
    "MsMpEng.exe", "NisSrv.exe", "SecurityHealthService.exe", "SentinelAgent.exe", "SentinelHelperService.exe", "SentinelServiceHost.exe", "CSFalconService.exe",
    "CrowdStrike.exe", "elastic-agent.exe", "ekrn.exe", "egui.exe", "avgnt.exe", "avguard.exe", "avp.exe", "kavfsslp.exe", "klnagent.exe", "mfemms.exe", "masvc.exe",
    "macmnsvc.exe", "mcshield.exe", "McAfee*.exe", "TmListen.exe", "PccNTMon.exe", "NTRtScan.exe", "TmCCSF.exe", "ds_agent.exe", "backup.exe",
    "BackupExecAgentAccelerator.exe", "BackupExecAgentBrowser.exe", "BackupExecDeviceMediaService.exe", "BackupExecJobEngine.exe", "BackupExecManagementService.exe",
    "BackupExecRPCService.exe", "BackupExecVSSProvider.exe", "bedbg.exe", "benetns.exe", "beserver.exe", "pvlsvr.exe", "raw_agent_svc.exe", "CagService.exe", "Sage.exe",
    "QBW32.exe", "QBDBMgr.exe", "QBDBMgrN.exe", "QBCFMonitorService.exe", "mysqld.exe", "mysqld-nt.exe", "mysqld-opt.exe", "postgres.exe", "PostgreSQL.exe", "node.exe",
    "java.exe", "Tomcat*.exe", "httpd.exe", "nginx.exe", "zoolz.exe",
)
STOPPED_SERVICES = (
    "vss", "SQLServerAgent", "MSSQLSERVER", "MSSQL$*", "SQLBrowser", "SQLWriter", "ReportServer", "ReportServer$*", "SQLAgent$*", "SQLAnywhere", "SQLADHLP", "SQLTELEMETRY",
    "Veeam Backup Service", "Veeam Backup Catalog Data Service", "Veeam Backup CDP Service", "Veeam Backup Cloud Gateway Service", "Veeam Backup Cloud Gateway",
    "Veeam Backup Indexing", "Veeam Backup Manager", "Veeam Backup Service Provider", "Veeam Backup Transport", "Veeam vPower NFS", "Veeam Mount Service",
    "Veeam Distribution Service", "Veeam DeploymentService", "Veeam Installer Service", "Veeam Plug-in", "VeeamBackupSvc", "VeeamCatalogSvc", "VeeamCloudSvc",
    "VeeamDeploySvc", "VeeamDeploymentService", "VeeamDistributionSvc", "VeeamEnterpriseManagerSvc", "VeeamMountSvc", "VeeamNFSSvc", "VeeamRESTSvc", "VeeamTransportSvc",
    "GxVss", "GxBlr", "GxFWD", "GxCVD", "GxCIMgr", "BackupExecAgentAccelerator", "BackupExecAgentBrowser", "BackupExecDeviceMediaService", "BackupExecJobEngine",
    "BackupExecManagementService", "BackupExecRPCService", "BackupExecVSSProvider", "AcrSch2Svc", "AcronisAgent", "ARSM", "ASPNET", "BesClient", "CASAD2DWebSvc", "CCSF",
    "Catalog Server", "CIM Object Manager", "DCAgent", "EhttpSrv", "EPSecurityService", "EPUpdateService", "EraSrv", "EsgShKernel", "ESHASRV", "FA_Scheduler",
    "HealthService", "IISADMIN", "IMAP4Svc", "KAVFS", "KAVFSGT", "kavfsslp", "klnagent", "mbamservice", "mfefire", "mfevtp", "McShield", "McTaskManager", "mfemms",
    "mozyprobackup", "MsDtsServer", "MsDtsServer100", "MsDtsServer110", "MMS", "MsMpSvc", "MSExchangeES", "MSExchangeIS", "MSExchangeMTA", "MSExchangeMGMT", "MSExchangeSA",
    "MSExchangeSRS", "MSExchangeADTopology", "MSExchangeAntispamUpdate", "MSExchangeDelivery", "MSExchangeDiagnostics", "MSExchangeEdgeSync", "MSExchangeFastSearch",
    "MSExchangeFrontEndTransport", "MSExchangeHM", "MSExchangeIMAP4", "MSExchangeMailboxAssistants", "MSExchangeMailboxReplication", "MSExchangePOP3", "MSExchangePop3BE",
    "MSExchangeImap4BE", "MSExchangeRepl", "MSExchangeRPC", "MSExchangeServiceHost", "MSExchangeThrottling", "MSExchangeTransport", "MSExchangeTransportLogSearch",
    "MSExchangeUM", "MSExchangeUMCR", "MSOLAP$SQL_2008", "MSSQL$BKUPEXEC", "MSSQL$ECWDB2", "MSSQL$PRACTICEMGT", "MSSQL$PROFXENGAGEMENT", "MSSQL$SBSMONITORING",
    "MSSQL$SHAREPOINT", "MSSQL$SQL_2008", "MSSQL$SYSTEM_BGC", "MSSQL$TPS", "MSSQL$TPSAMA", "MSSQL$VEEAMSQL2008", "MSSQL$VEEAMSQL2012", "MSSQLFDLauncher",
    "MSSQLServerADHelper", "MSSQLServerADHelper100", "MSSQLServerOLAPService", "NetBackup BMR MTFTP Service", "NetMsmqActivator", "ntrtscan", "OracleClientCache80",
    "PDVFSService", "POP3Svc", "PortalSvc", "QBCFMonitorService", "QBVSS", "QBIDPService", "ReportServer$TPS", "ReportServer$TPSAMA", "ReportServer$SQL_2008",
    "ReportServer$SYSTEM_BGC", "RTVscan", "SAVAdminService", "SAVService", "SDRSVC", "SepMasterService", "ShMonitor", "Smcinst", "SmcService", "SMTPSvc", "SNAC",
    "SntpService", "sophos", "SophosAgent", "SophosAutoUpdateService", "SophosClean", "SophosDeviceControlService", "SophosFIM", "SophosHealth", "SophosMcsAgent",
    "SophosMcsClient", "SophosMessageRouter", "SophosNtpService", "SophosRms", "SophosSafestore", "SophosSystemProtectionService", "SophosWebControlService", "SQLPBDMS",
    "SQLPBENGINE", "stc_raw_agent", "swi_filter", "swi_service", "swi_update", "swi_update_64", "TmCCSF", "tmlisten", "TrueKey", "TrueKeyScheduler", "TrueKeyServiceHelper",
    "UI0Detect", "VeeamBrokerSvc", "W3Svc", "wbengine", "WRSVC", "YooBackup", "YooIT", "zhudongfangyu",
)
BCDEDIT_PATTERNS = ("recoveryenabled no", "bootstatuspolicy ignoreallfailures", "safeboot network")
VSSADMIN_PATTERN, WMIC_PATTERN = "delete shadows", "shadowcopy delete"
WEVTUTIL_PATTERNS = (" cl ", "clear-log")
CLEAR_SCRIPTS = ("Clear-EventLog", "Remove-EventLog", "wevtutil cl")
DEFENDER_SCRIPTS = ("Set-MpPreference -DisableRealtimeMonitoring", "Add-MpPreference -ExclusionPath")
RMM_BINARIES = ("anydesk.exe", "teamviewer.exe", "ScreenConnect.WindowsClient.exe")
RMM_SAFE = ("c:\\program files\\", "c:\\program files (x86)\\")
ADMIN_SHARES = ("ADMIN$", "C$", "D$", "IPC$")
SHELLS = ("explorer.exe",)
ADMINISTRATORS = "S-1-5-32-544"
HISTORY_FILE = "ConsoleHost_history.txt"
# ---- End of fixed values ----

COMPLETE = {"HVCI_VALUES", "WEBDAV_INDICATORS", "ZEMANA_THUMBPRINT", "CHISEL_INDICATORS", "IMPACKET_REDIRECTS", "BCDEDIT_PATTERNS", "WORKER_SUFFIX"}
